"""Pages whose article stands where furniture often does."""

import time

import pytest

from memgrid.llm.html_text import extracted

A = "The river rose through the night, and by morning the lower fields, the mill and both bridges stood under water."
B = "People had moved what they could to the upper floors, and the boats went from door to door until noon."
C = "It was, as the council said, the third flood in ten years, though none had come so early in the season."
BODY = f"<h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"Flood {A} {B} {C}"


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm"><input type=hidden name=x><div id=nav><a href=/>Home</a> <a href=/a>All</a></div><div class=content>{BODY}</div><input name=q><button>Go</button></form>',
        f"<form action=/><table><tr><td><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></td><td>{BODY}</td></tr></table></form>",
        f"<div><p title=it's>{A}</p><h2>x</h2><p data-note=don't>{B}</p></div>",
        f"<article>{BODY}<form class=f><label>Your name</label><input name=n><label>Your mail</label><input name=m><textarea>Say it</textarea><button>Send</button></form></article>",
        f"<article><h1>Flood</h1><p>{A}</p><fieldset><p>{B}</p></fieldset><p>{C}</p></article>",
        f"<article><h1>Flood</h1><p>{A}</p><aside><p>Both bridges are closed.</p></aside><p>{B}</p></article>",
        f"<article>{BODY}<div class=discussion-thread><p>{B} I was there, and it was worse than that, much worse.</p><p>{C} Nobody asked us, and nobody will.</p></div></article>",
    ],
)
def test_the_article_is_found(page):
    want = {2: f"{A} x {B}", 5: f"Flood {A} Both bridges are closed. {B}"}
    at = next(n for n, x in enumerate(("aspnetForm", "action=/", "it's", "Your name", "fieldset", "aside", "discussion")) if x in page)
    assert extracted(page) == want.get(at, TEXT)


def test_references_are_text_and_menus_are_not():
    refs = "<ul><li><a href=1>A history of floods in the lower valley</a></li><li><a href=2>The mill and its bridges, a survey of two centuries</a></li></ul>"
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Contact</a></li></ul>"
    assert extracted(f"<article>{BODY}<h2>Further reading</h2>{refs}</article>") == f"{TEXT} Further reading A history of floods in the lower valley The mill and its bridges, a survey of two centuries"
    assert extracted(f"<article>{menu}{BODY}</article>") == TEXT


def test_forms_alone_are_left_out():
    assert extracted("<body><form><label>Name</label><input><label>Mail</label><input><button>Send</button></form></body>") == ""


def test_odd_attributes_take_linear_time():
    at = time.perf_counter()
    for odd in ("<p " + "a=" * 200_000, "<p " + "='" * 200_000 + ">x", "<p " + "a='b" * 200_000, "<p " + "= " * 200_000 + ">", "<a b" * 50_000):
        extracted(odd)
    assert time.perf_counter() - at < 30
