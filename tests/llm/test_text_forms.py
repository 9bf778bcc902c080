"""Operators 11 to 13 against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from memgrid.llm import fill_middle, personal_data, prefix_trie, registry

Q = registry.queries()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    """Nodes of the trie of rows (conv_id, turn, role, text), whose turns must be told apart by number or be equal."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for k, v in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    return sorted((min(v), len(k), str(min(members[k[:-1]]) if k else None), len(v), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, v in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(rows):
    return sorted(tuple(str(r[c]) if c == "parent_conv_id" else r[c] for c in COLUMNS) for r in rows)


@pytest.fixture
def talk(spark, folder):
    return spark.read.parquet(f"{folder}/conversations.parquet")


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3, "HEAVY": 2, "PIECE": 4}])
def test_op11_equals_plain_trie(spark, folder, talk, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(prefix_trie, k, v)
    monkeypatch.setattr(prefix_trie.base, "parts_for", lambda df, n, **k: 7)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in talk.collect()]
    tied = [x for x in rows if x[:2] == (7, 2)]
    assert len(tied) == 2
    rows = [x for x in rows if x[3] != "tie"]
    assert nodes(prefix_trie.trie(talk.where("text is null or text <> 'tie'")).collect()) == plain_trie(rows)
    assert len(prefix_trie.trie(talk).collect()) > 100


def test_op11_ties_have_one_order(spark, talk):
    again = talk.repartition(5, "text")
    assert nodes(prefix_trie.trie(talk).collect()) == nodes(prefix_trie.trie(again).collect())


def test_op11_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert_same(Q["op11_prefix_trie"](spark, folder), registry.oracle_sql()["op11_prefix_trie"], folder)


def test_op11_conversations_without_turns(spark):
    """12 loses all its turns to a family whose first conversation isn't there."""
    c = next(c for c in range(11, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    got = nodes(prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(c, 0, "None", 1, 0, 1, 0, sha(str(c)))]


def test_op13_equals_sql(spark, folder):
    from compare import connected

    con = connected("/nowhere")
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["op13_fill_middle"]).fetchall()
    names = [x[0] for x in con.description]
    got = Q["op13_fill_middle"](spark, folder).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in names)) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.text("ab<>PSM é\n😀", max_size=60), st.integers(0, 10**6))
def test_op13_round_trip(text, doc_id):
    n, form, prefix, middle, output = fill_middle.transformed(text, doc_id)
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert n == len(tokens) and fill_middle.restored(output, form) == text
    if form != "plain":
        a, b = sorted(x % (n + 1) for x in fill_middle.chosen(doc_id)[:2])
        assert (prefix, middle) == (len("".join(tokens[:a])), len("".join(tokens[a:b])))


@pytest.mark.parametrize(("step", "kinds"), [(1, {"runs"}), (2, {"bitmap"}), (40, {"array"})])
def test_op13_containers(step, kinds):
    offsets = np.arange(3, 200_000, step)
    held = fill_middle.BoundarySet(offsets)
    assert {c.kind for c in held.containers[:-1]} == kinds and len(held) == len(offsets)
    assert [held.select(k) for k in range(0, len(offsets), 97)] == offsets[::97].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300_000), unique=True, min_size=1, max_size=200))
def test_op13_any_set(offsets):
    offsets = np.sort(np.array(offsets))
    held = fill_middle.BoundarySet(offsets)
    assert [held.select(k) for k in range(len(held))] == offsets.tolist()


def valid_luhn(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        v = int(x) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_personal(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and valid_luhn(d)]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def base_spans(text):
    return [(personal_data.KINDS[k], a, z) for k, a, z, _ in personal_data.scanned(text) if k < personal_data.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text("ab.@-+ 0125(_é", max_size=50))
def test_op12_base_equals_plain_patterns(text):
    assert base_spans(text) == plain_personal(text)


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c@d.e_x@y.z..q@w.v", "1.2.3.4.5.6.7.8.9 and 256.1.1.1.1.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 5 4", "+49 (0) 30 123456-", "+1 2 +33 1.23.45.67.89)",
        "x" * 50_000 + "@" + "y" * 50_000, "1" * 60_000, "@" * 5000, "1." * 30_000, "+1" * 3000, "9 " * 30_000, "+1" + "(" * 50_000,
    ],
)
def test_op12_odd_texts(text):
    long = [("ip", k, k + 7) for k in range(0, len(text), 8)] if text.startswith("1.1") else []
    assert base_spans(text) == (plain_personal(text) if len(text) < 20_000 else long)


def test_op12_is_linear_in_long_texts():
    import time

    at = time.perf_counter()
    for text in ("x" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "A1" * 1_000_000, "01 " * 600_000):
        personal_data.scanned(text)
    assert time.perf_counter() - at < 60


def test_op12_query(spark, folder, docs):
    want = []
    for i, text, *_ in docs:
        own = plain_personal(text or "")
        counts = [sum(x[0] == k for x in own) for k in ("email", "ip", "card", "phone")]
        want.append((i, *counts, sha(",".join(f"{k}:{a}:{z}" for k, a, z in own))))
    rows = Q["op12_personal_data"](spark, folder).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in rows)


def kinds(text):
    return [personal_data.KINDS[k] for k, *_ in personal_data.scanned(text)]


def test_op12_checksums_confirm():
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("bank GB82WEST12345698765432 x") == ["iban"] and kinds("GB82WEST12345698765432A") == []
    assert kinds("DNI 12345678Z") == ["es_dni"] and kinds("DNI 12345678A") == []
    body = next(b for b in range(1840775123456, 1840775123556) if not valid_luhn(f"{b}{97 - b % 97:02}"))
    assert kinds(f"nir {body}{97 - body % 97:02}") == ["fr_nir"] and "fr_nir" not in kinds(f"nir {body}{(97 - body % 97) % 97 + 1:02}")
    assert kinds("nir 2 55 08 14 168 025 38") == ["card"]  # a base span stays


def test_op12_context_decides():
    assert kinds("my ssn is 123-45-6789") == ["us_ssn"] and kinds("part 123-45-6789 is sold") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("call 030 1234567 now") == ["local_phone"] and kinds("it took 030 1234567 steps") == []
    assert kinds("order 123-45-6789 ssn") == []


def test_op12_redacts(spark):
    rows = [(1, "mail a@b.org or +49 30 1234567", 5), (2, None, 6), (3, "none", None)]
    got = personal_data.redacted(spark.createDataFrame(rows, "doc_id long, TEXT string, spans int")).collect()
    assert [tuple(r) for r in got] == [(1, "mail [EMAIL] or [PHONE]", 5), (2, None, 6), (3, "none", None)]
