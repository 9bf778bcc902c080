"""Each query against a plain version of its contract, on few but odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from memgrid.llm import registry

Q = registry.queries()
BIG = 1 << 63
SPACE = "[\x20\x09-\x0d]+"


def run(spark, name, folder):
    return Q[name](spark, folder).collect()


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id, by):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_table(spark, empty, name):
    assert run(spark, name, empty) == []


def sorted_rows(rows):
    return sorted(map(repr, rows))


def test_op1_base_counts(spark, folder, docs):
    want = []
    for i, text, *_ in docs:
        text = text or ""
        own = words(text)
        grams = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
        hit = [0] * len(own)
        for k in range(len(own) - 7):
            if grams[tuple(own[k : k + 8])] > 1:
                hit[k : k + 8] = [1] * 8
        seen, again = set(), 0
        for line in text.split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        failed = len(own) < 20 or 100 * sum(hit) > 30 * len(own)
        want.append((i, len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), again, sum(hit), failed))
    rows = run(spark, "op1_quality_rules", folder)
    assert sorted_rows(want) == sorted_rows((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_op1_perplexity_rejects_what_lies_far_out(spark):
    from memgrid.llm import quality

    rows = [(i, "the house on the hill was old and the people in it were kind to all who came by on their way " * 1 + f"number {i} " + "and then they went home to rest", "en") for i in range(80)]
    rows.append((999, " ".join("".join(chr(97 + (k * k * 7 + j * 31 + k) % 26) for j in range(9)) for k in range(40)), "en"))
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[999] and all(got[i] for i in range(80))


def test_op1_tails_are_cut_where_they_leave_the_body():
    from memgrid.llm.quality import tail_limit

    body = {k: round(40_000 / 2 ** (k * k / 8)) for k in range(14)}
    assert tail_limit(body) == 3.5
    assert 3.5 <= tail_limit(body | {k: 40 for k in range(18, 26)}) <= 4
    heavy = {k: round(40_000 / 1.5**k) for k in range(25)}
    assert 4.5 <= tail_limit(heavy | {k: 90 for k in range(21, 29)}) < 6.5
    assert tail_limit({}) == 3.5


def test_op1_rejects_lists_and_symbols(spark):
    from memgrid.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = [r for r in quality.judged(docs).collect() if not r["base_failed"] and r["doc_id"] in labels]
    lists = [r["kept"] for r in rows if labels[r["doc_id"]] == 0 and " | " in text[r["doc_id"]]]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    assert lists and not all(lists) and sum(good) >= 0.995 * len(good)


def test_op1_languages_of_few_texts_have_a_band(spark):
    from memgrid.llm import quality

    say = "the house on the hill was old and the people in it were kind to all who came by on their way and then they went home to rest"
    junk = [" ".join("".join(chr(97 + (k * k * 7 + j * 31 + k * s) % 26) for j in range(9)) for k in range(40)) for s in (1, 3)]
    rows = [(i, f"{say} {i}", "en") for i in range(80)] + [(100, junk[0], "xx"), (101, junk[1], "yy"), (102, say, "zz"), (103, say, "yy")]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and not got[101] and all(got[i] for i in (*range(80), 102, 103))


def test_kneser_ney_sums_to_one(spark):
    import numpy as np

    from memgrid.llm.kneser_ney import Model, padded_codes

    line = np.random.default_rng(1).choice(5, 400, p=[0.4, 0.3, 0.15, 0.1, 0.05]).astype(np.uint64)
    codes, counts = np.unique(padded_codes(line, np.zeros(400, int), 1, 3, 6), return_counts=True)
    for modified in (False, True):
        model = Model(codes, counts[:, None], 3, 6, 5, modified)
        for context in ((0, 1), (2, 2), (4, 3), (63, 63)):
            ends = np.array([(context[0] << 12) | (context[1] << 6) | s for s in range(5)], np.uint64)
            assert np.exp(model.scores(ends)[:, 0]).sum() == pytest.approx(1, abs=1e-4)


def test_probabilities_are_those_of_the_model(spark):
    """The joins give what the arrays in memory give."""
    import numpy as np

    from memgrid.llm.kneser_ney import Model, padded_codes, probabilities

    line = np.random.default_rng(2).choice(7, 3000, p=[0.4, 0.3, 0.15, 0.1, 0.03, 0.01, 0.01]).astype(np.uint64) + np.uint64(65)
    codes, counts = np.unique(padded_codes(line, np.zeros(3000, int), 1, 4, 16), return_counts=True)
    model = Model(codes, counts[:, None], 4, 16, len(np.unique(line)) + 1, True)
    grams = spark.createDataFrame([(int(c.view(np.int64)), int(n)) for c, n in zip(codes, counts, strict=True)], "code long, n long")
    got = {r["code"]: r["logp"] for r in probabilities(grams, 4, 16).collect()}
    want = model.scores(codes)[:, 0]
    assert len(got) == len(codes)
    assert [got[int(c.view(np.int64))] for c in codes] == pytest.approx(want.tolist(), abs=1e-4)


def test_op1_perplexity_by_hand(spark, docs, folder):
    """log_perplexity of each text from a dictionary of counts."""
    import numpy as np

    from memgrid.llm.kneser_ney import Model
    from memgrid.llm.quality import coded

    texts = [t or "" for _, t, *_ in docs]
    all_codes, owner = coded(texts)
    codes, counts = np.unique(all_codes, return_counts=True)
    symbols = len(np.unique(codes & np.uint64(0xFFFF))) + 1
    scores = Model(codes, counts[:, None], 4, 16, symbols, True).scores(all_codes)[:, 0]
    n = np.array([len(words(t)) for t in texts])
    want = -np.bincount(owner, scores, len(texts)) / np.maximum(n, 1)
    want = sorted((repr(i), float(x) if k else -1.0) for (i, *_), x, k in zip(docs, want, n, strict=True))
    got = sorted((repr(r["doc_id"]), -1.0 if r["log_perplexity"] is None else r["log_perplexity"]) for r in run(spark, "op1_quality_rules", folder))
    assert [k for k, _ in want] == [k for k, _ in got]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-3)


def test_op1_kept_follows_bands(spark, folder):
    for r in run(spark, "op1_quality_rules", folder):
        inside = all(r[x] is None or r[p + "low"] <= r[x] <= r[p + "high"] for x, p in (("log_perplexity", ""), ("unit_log_perplexity", "unit_")))
        assert r["kept"] == (not r["base_failed"] and inside)


def test_op1_clashing_names(spark):
    from memgrid.llm import quality

    names = ["middle", "spread", "_lang", "row", "block", "doc", "kept", "low", "high", "log_perplexity", "n_words"]
    text = "the house on the hill was old and the people in it were kind to all who came by on their way home number"
    docs = spark.createDataFrame([(i, f"{text} {i}", "en", *names) for i in range(30)], ["doc_id", "text", "lang", *names])
    out = quality.filtered(docs)
    assert out.columns == docs.columns and out.count() == 30 and {tuple(r[3:]) for r in out.collect()} == {tuple(names)}


def test_op2_contract(spark, folder, docs):
    rows = run(spark, "op2_language_id", folder)
    assert len(rows) == len(docs)
    learned = {lang for i, text, lang, _ in docs if lang is not None and remainder(i, 5) and text}
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
    und = Counter(r["lang_pred"] == "und" for r in rows)[True]
    assert und == sum(not any(c.isalpha() for c in text or "") for _, text, *_ in docs)
    assert {r["lang_pred"] for r in rows} <= learned | {"und"}


def test_op2_accuracy_on_held_out(spark):
    rows = run(spark, "op2_language_id", "/root/testdata/sf0.001")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def plain_nats(train, texts, symbols, order=5):
    """Nats a symbol of each text under an interpolated Kneser-Ney model of the texts `train`, by dictionaries."""

    def grams(t):
        line = "".join(c + " " for c in "".join(c if c.isalpha() else " " for c in t.lower()).split())
        line = " " * (order - 1) + line  # what stands before a text is space as well
        return [line[k - order + 1 : k + 1] for k in range(order - 1, len(line))]

    tables = {order: Counter(g for t in train for g in grams(t))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    off, total, taken = {}, defaultdict(int), defaultdict(float)
    for n, table in tables.items():
        n1, n2 = (sum(c == k for c in table.values()) for k in (1, 2))
        off[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        for g, c in table.items():
            total[n, g[:-1]] += c
            taken[n, g[:-1]] += off[n]

    def probability(g):
        n = len(g)
        if not n:
            return 1 / symbols
        if not total[n, g[:-1]]:
            return probability(g[1:])
        c = tables[n][g]
        return ((c - off[n] if c else 0) + taken[n, g[:-1]] * probability(g[1:])) / total[n, g[:-1]]

    return [-sum(math.log(probability(g)) for g in grams(t)) / max(len(grams(t)), 1) for t in texts]


def test_op2_by_hand(spark):
    """Cross-entropies and languages from dictionaries of counts."""
    import numpy as np

    from memgrid.llm.kneser_ney import Model, counted
    from memgrid.llm.language_id import BITS, ORDER, Languages, coded, identified

    train = {"aa": ["the cat sat on the mat and the dog ran", "a dog and a cat ran to the hat"], "bb": ["le chat est sur la table et le chien court", "un chien et un chat"]}
    texts = ["the dog sat", "le chien est la", "chat the", "zzz", "Cat, MAT!"]
    rows = spark.createDataFrame([(lang, t) for lang, own in train.items() for t in own], "lang string, text string")
    got = counted(rows, "lang", coded).toArrow()
    codes, at = np.unique(got["code"].to_numpy().view(np.uint64), return_inverse=True)
    counts = np.zeros((len(codes), 2))
    np.add.at(counts, (at, np.array([x == "bb" for x in got["lang"].to_pylist()], int)), got["n"].to_numpy())
    symbols = len(np.unique(codes & np.uint64((1 << BITS) - 1))) + 1
    languages = Languages(["aa", "bb"], Model(codes, counts, ORDER, BITS, symbols, modified=False))
    out = {r["doc_id"]: r for r in identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), languages).collect()}
    want = {lang: plain_nats(own, texts, symbols) for lang, own in train.items()}
    for k in range(len(texts)):
        nats = [want["aa"][k], want["bb"][k]]
        assert out[k]["nats"] == pytest.approx(min(nats), abs=1e-4)
        assert out[k]["lang_pred"] == ("aa" if nats[0] <= nats[1] else "bb")


def test_op2_language_of_empty_texts(spark):
    from memgrid.llm.language_id import identified, learned

    rows = [(i, f"the cat sat on the mat {i}", "en") for i in range(40)] + [(i, "", "xx") for i in range(100, 110)] + [(i, "12 34", "yy") for i in range(200, 210)]
    docs = spark.createDataFrame([*rows, (300, "le chat est la", "fr"), (301, None, "zz")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in identified(docs, learned(docs)).collect()}
    assert got[0] == "en" and got[300] == "fr" and got[100] == got[200] == got[301] == "und"


def test_op3_components(spark, folder, docs):
    prints = []
    for i, text, *_ in docs:
        own = words(lowered(text))
        grams = [" ".join(own[k : k + 4]) for k in range(max(1, len(own) - 3))] if own else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    least, nodes = {}, sorted({f for _, f in prints})
    label = {f: f for f in nodes}
    for _ in nodes:
        new = {f: min(label[g] for g in nodes if (f ^ g).bit_count() <= 4) for f in nodes}
        if new == label:
            break
        label = new
    for i, f in prints:
        least[label[f]] = min(least.get(label[f], BIG), BIG if i is None else i)
    want = [(i, f"{f:016x}", None if least[label[f]] == BIG else least[label[f]]) for i, f in prints]
    assert sorted_rows(want) == sorted_rows((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op3_simhash_pivots", folder))


def test_op3_tiles_give_the_same_links(spark, monkeypatch):
    import random

    from memgrid.llm import simhash

    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for _ in range(60)}
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))], "doc_id long, fingerprint long")
    want = sorted(map(tuple, simhash.near_groups(rows).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(simhash, "TILE", 5)
    assert want == sorted(map(tuple, simhash.near_groups(rows).select("doc_id", "component_id").collect()))
    more = simhash.links(rows.select("fingerprint"), 4, 7)
    assert more.count() > 0


def plain_items(docs, items, least=0.8, size=5):
    """The best similarity of any window to each item, by all windows of all documents."""
    cut = lambda own, n: [tuple(own[k : k + n]) for k in range(len(own) - n + 1)]
    items = [(k, words(lowered(t))) for k, t in items]
    items = [(k, own, min(size, len(own))) for k, own in items if own]
    rarity = Counter(g for _, own, n in items for g in set(cut(own, n)))
    weight = lambda g: math.log(1 + len(items) / rarity.get(g, 1))
    holders = defaultdict(set)
    for at, (_, own, n) in enumerate(items):
        for g in cut(own, n):
            holders[g].add(at)
    found = []
    for i, text in docs:
        own = words(lowered(text))
        have = {g for n in range(1, size + 1) for g in cut(own, n)}
        for at in set().union(*(holders[g] for g in have & holders.keys())):
            k, item, n = items[at]
            grams, target, best = cut(own, n), Counter(cut(item, n)), 0
            width = min(len(item), len(own)) - n + 1
            for s in range(len(grams) - width + 1):
                window = Counter(grams[s : s + width])
                both = sum(weight(g) * min(c, target[g]) for g, c in window.items() if g in target)
                if both:
                    best = max(best, both / (sum(weight(g) * c for g, c in (window | target).items())))
            if best >= least:
                found.append((i, k, round(best, 6)))
    return found


def test_op4_all_windows(spark, folder, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = plain_items([(i, t) for i, t, *_ in docs], items)
    rows = run(spark, "op4_decontamination", folder)
    assert sorted_rows(want) == sorted_rows((r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in rows)
    assert all(0 <= r["start"] < r["end"] for r in rows)


def changed_items(spark):
    """Items that share shingles among them, and documents with items whose middle or edges were changed."""
    import random

    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    common = say(12)
    items = [common + say(r.randint(3, 90)) + common[: r.randint(0, 8)] for _ in range(40)]
    rows = []
    for k, item in enumerate(items * 4):
        own = list(item)
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(own))
            own[at : at + r.randint(0, 1)] = say(r.randint(0, 8))
        rows.append((k, " ".join(say(r.randint(0, 30)) + own + say(r.randint(0, 30)))))
    return rows, [(k, " ".join(x)) for k, x in enumerate(items)]


def test_op4_changed_items_and_blocks(spark, monkeypatch):
    from memgrid.llm import decontaminate

    rows, items = changed_items(spark)
    want = plain_items(rows, items)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pick = lambda df: sorted_rows((r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in df.collect())
    assert len(want) > 60 and pick(decontaminate.contaminated(docs, benchmark)) == sorted_rows(want)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert pick(decontaminate.contaminated(docs, benchmark)) == sorted_rows(want)
    kept = {r["doc_id"] for r in decontaminate.cleaned(docs, benchmark).collect()}
    assert kept == {i for i, _ in rows} - {i for i, *_ in want}


def test_op4_driver_tables(spark):
    at = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    want = plain_items(docs, items)
    assert want and sorted_rows(want) == sorted_rows((r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in run(spark, "op4_decontamination", at))


def covered(docs, cut, size):
    """Rows (doc_id, units, flags): units in a window that also starts under a smaller id."""
    least = {}
    split = [(i, cut(text)) for i, text, *_ in docs]
    for i, own in split:
        for k in range(len(own) - size + 1):
            key = own[k : k + size]
            least[key] = min(least.get(key, BIG), BIG if i is None else i)
    for i, own in split:
        flags = bytearray(len(own))
        for k in range(len(own) - size + 1):
            if least[own[k : k + size]] < (BIG if i is None else i):
                flags[k : k + size] = b"\1" * size
        yield i, own, flags


def test_op5_bytes(spark, folder, docs):
    want = []
    for i, own, flags in covered(docs, lambda t: (t or "").encode(), 50):
        kept = bytes(b for b, f in zip(own, flags, strict=True) if not f)
        want.append((i, len(own), sum(flags), len([x for x in bytes(flags).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    got = run(spark, "op5_suffix_array", folder)
    assert sorted_rows(want) == sorted_rows((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def test_deep_shallow_sorts():
    import numpy as np

    from memgrid.llm.suffixes import deep_shallow

    r = np.random.default_rng(4)
    for size, letters in ((50, 2), (17, 2), (60, 3), (9, 26)):
        text = r.integers(97, 97 + letters, 3000).astype(np.uint8)
        text[1000:2000] = text[:1000]
        starts = r.permutation(3000 - size)[:1500]
        order, new = deep_shallow(text, starts, size, 8)
        strings = [text[starts[i] : starts[i] + size].tobytes() for i in order]
        assert strings == sorted(strings)
        assert new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_op6_matches_sql(spark, folder, docs):
    from compare import rows_of

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()["op6_sainte_lague"])
    columns = [x[0] for x in found.description]
    df = Q["op6_sainte_lague"](spark, folder)
    rows = df.collect()
    assert rows_of(df.columns, map(tuple, rows)) == rows_of(columns, found.fetchall())
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * total) < 0.02 * total + 200


def test_apportioned_is_highest_quotients(spark):
    from pyspark.sql import functions as F

    from memgrid.llm import mixture

    for weights, seats in (([53, 24, 23], 7), ([1, 1, 1, 1], 6), ([1000, 1, 1], 11), ([5, 3, 0], 4), ([7, 7, 2, 90, 4], 101)):
        rows = spark.createDataFrame([(1, k, w) for k, w in enumerate(weights, 1)], "g int, k int, w long")
        got = {r["k"]: r["quota"] for r in mixture.apportioned(rows, ["g"], "k", F.col("w") / sum(weights), F.lit(seats)).collect()}
        want = Counter({k: 0 for k in got})
        for _ in range(seats):
            want[max(got, key=lambda k: (weights[k - 1] / (2 * want[k] + 1), -k))] += 1
        assert got == dict(want)


def test_op7_base(spark, folder, docs):
    counts = Counter()
    for i, text, *_ in docs:
        if remainder(i, 7) != 2:
            counts.update([*words(lowered(text)), " "])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, text, *_ in docs:
        own = [*words(lowered(text)), " "]
        want[repr(i)].append((remainder(i, 7) == 2, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    got = defaultdict(list)
    for r in run(spark, "op7_class_model", folder):
        got[repr(r["doc_id"])].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
        assert r["score"] < 0
    assert want.keys() == got.keys()
    for key, rows in want.items():
        for a, b in zip(sorted(rows), sorted(got[key]), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def plain_class_scores(docs, label, classes, n_ends, unseen):
    """Scores of all texts under given word classes, by dictionaries."""
    train = [[*words(lowered(t))] for i, t, *_ in docs if remainder(i, 7) != 2]
    counts = Counter(w for own in train for w in own)
    follow, mass, kinds = Counter(), Counter(), Counter()
    for own in train:
        line = ["end", *(label[w] for w in own), "end"]
        follow.update(zip(line, line[1:], strict=False))
    for w, n in counts.items():
        mass[label[w]] += n
        kinds[label[w]] += 1
    mass["end"], kinds["end"] = n_ends, 1
    out = Counter()
    for a, _ in list(follow):
        out[a] = sum(n for (x, _), n in follow.items() if x == a)
    found = []
    for i, t, *_ in docs:
        line, score = "end", 0.0
        for w in [*words(lowered(t)), None]:
            c = "end" if w is None else label.get(w, unseen)
            n = n_ends if w is None else counts[w]
            score += math.log10((follow[line, c] + 0.1) / (out[line] + 0.1 * (classes + 1))) + math.log10((n + 1) / (mass[c] + kinds[c] + 1))
            line = c
        found.append((repr(i), round(score, 4)))
    return sorted(found)


def test_op7_score_by_hand(spark, folder, docs):
    """Every training word has a class, chosen as the docstring says, and scores follow from classes and counts."""
    import numpy as np

    from memgrid.llm import class_model as m

    df = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = m.Lexicon(df.where(m.remainder(7) != 2), class_words=40)
    rows = lexicon.words.collect()
    counts = Counter(w for i, t, *_ in docs if remainder(i, 7) != 2 for w in words(lowered(t)))
    assert {r["word"]: r["n"] for r in rows} == counts and len(rows) == len(counts) > 60
    label = {r["word"]: r["class"] for r in rows}
    assert 0 <= min(label.values()) and max(label.values()) < lexicon.classes

    # classes of the words beyond the clustered ones, by dictionaries
    top = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:40]}
    k = lexicon.classes
    own = {w: label[w] for w in top}
    pairs, before, after = np.zeros((k + 2, k + 2)), defaultdict(Counter), defaultdict(Counter)
    for i, t, *_ in docs:
        if remainder(i, 7) != 2:
            text = words(lowered(t))
            line = [k, *(own.get(w, k + 1) for w in text), k]
            for a, b in zip(line, line[1:], strict=False):
                pairs[a, b] += 1
            for at, w in enumerate(text, 1):
                before[w][line[at - 1]] += 1
                after[w][line[at + 1]] += 1
    # between two texts stands one end
    follow = np.log((pairs + 0.1) / (pairs.sum(axis=1, keepdims=True) + 0.1 * (k + 2)))
    mass = np.log(pairs.sum(axis=0)[:k] + 1)
    for w in counts.keys() - top:
        gain = sum(n * follow[c, :k] for c, n in before[w].items()) + sum(n * follow[:k, c] for c, n in after[w].items()) - counts[w] * mass
        assert gain[label[w]] >= gain.max() - 1e-6

    monkey = m.CLASS_WORDS
    whole = m.Lexicon(df.where(m.remainder(7) != 2), class_words=monkey)
    label = {r["word"]: r["class"] for r in whole.words.collect()}
    single = Counter(label[w] for w, n in counts.items() if n == 1)
    unseen = max(range(whole.classes), key=lambda c: (single[c], -c))
    want = plain_class_scores(docs, label, whole.classes, whole.ends, unseen)
    assert want == sorted((repr(r["doc_id"]), round(r["score"], 4)) for r in run(spark, "op7_class_model", folder))


def test_op7_beats_word_counts(spark):
    """The class model gives held-out texts a better probability than the base does."""
    rows = [r for r in run(spark, "op7_class_model", "/root/testdata/sf0.001") if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_op7_reads_texts_once(spark, folder, docs):
    """Texts are cut into words once; all else works on numbers (they were read four times and more)."""
    from pyspark.sql import functions as F

    from memgrid.llm import class_model as m

    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    read = F.udf(told, "string").asNondeterministic()
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", read("text").alias("text"))
    assert m.scored(df, m.remainder(7) != 2).count() == len(docs) == seen.value


def test_op7_blocks_agree(spark, folder, monkeypatch):
    """Scores don't depend on how documents are cut into blocks."""
    from memgrid.llm import class_model as m

    df = spark.read.parquet(f"{folder}/documents.parquet")
    pick = lambda x: sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in m.scored(x, m.remainder(7) != 2).collect())
    want = pick(df.coalesce(1))
    monkeypatch.setattr(m, "BLOCK_BYTES", 1)
    assert want == pick(df.repartition(9))


def test_op7_words_are_those_of_the_rule():
    import numpy as np
    import pyarrow as pa

    from memgrid.llm.class_model import words_of

    texts = ["", " \t\n", "  a B\x0b\x0cc\r\n a ", "É x\x85y\xa0z \u3000 ÀB", "one", "\x1c\x1f b"]
    for own in (texts, texts[2:3], ["", ""], []):
        starts, found = words_of(pa.array(own, pa.string()))
        got = found.to_pylist()
        assert [got[a:z] for a, z in zip(starts, starts[1:], strict=False)] == [words(lowered(t)) for t in own]
        assert np.all(np.diff(starts) >= 0) and len(got) == starts[-1]


def test_op7_words_with_one_hash_stay_apart():
    import pyarrow as pa

    from memgrid.llm.class_model import by_word

    rows = [(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "c", 4), (2, "c", 5), (3, "d", 6), (3, "e", 7), (3, "d", 8)]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("hash", "word", "n"), r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = []
        for t, first in by_word(iter(batches)):
            ends = [*first[1:].tolist(), len(t)]
            got += [(t["word"][a].as_py(), sorted(t["n"].slice(a, z - a).to_pylist())) for a, z in zip(first.tolist(), ends, strict=True)]
        assert sorted(got) == [("a", [1, 3]), ("b", [2]), ("c", [4, 5]), ("d", [6, 8]), ("e", [7])]


def test_exchange_finds_classes():
    import numpy as np

    from memgrid.llm.class_model import exchanged

    pairs = np.zeros((12, 12), np.int64)
    for i in range(12):
        for j in range(12):
            pairs[i, j] = 50 + i + j if (i // 4 + 1) % 3 == j // 4 else 0
    label = exchanged(pairs, 3)
    assert all(len(set(label[k : k + 4])) == 1 for k in (0, 4, 8)) and len(set(label)) == 3


def test_exchange_ends_where_no_move_helps():
    import numpy as np

    from memgrid.llm.class_model import exchanged, xlogx

    pairs = np.random.default_rng(3).integers(0, 30, (14, 14))
    label = exchanged(pairs, 3, fixed=2)
    assert label[:2].tolist() == [3, 4]

    def likelihood(label):
        one = np.eye(5)[label]
        table = one.T @ pairs @ one
        return xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum()

    best = likelihood(label)
    for i in range(2, 14):
        for c in range(3):
            other = label.copy()
            other[i] = c
            assert likelihood(other) <= best + 1e-6


def test_op8_words(spark, folder, docs):
    want = []
    for i, own, flags in covered(docs, lambda t: tuple(words(t)), 13):
        kept = " ".join(w for w, f in zip(own, flags, strict=True) if not f)
        want.append((i, len(own), sum(flags), hashlib.sha256(kept.encode()).hexdigest()))
    got = run(spark, "op8_substring_dedup", folder)
    assert sorted_rows(want) == sorted_rows((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)


@pytest.mark.parametrize("steps", [1, 3, 13])
def test_op8_levels_agree(spark, folder, steps):
    from memgrid.llm.substrings import levels, repeated_words

    assert levels(13) == [4, 8, 13] and levels(13, 1) == [1, 2, 4, 8, 13] and levels(3) == [3]

    df = spark.read.parquet(f"{folder}/documents.parquet")
    pick = lambda x: sorted(repr(tuple(r)) for r in x.collect())
    assert pick(repeated_words(df, 13, steps)) == pick(repeated_words(df, 13))


def test_op9_base_and_links(spark, folder, docs):
    kinds = (
        ("assign", re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    )
    want = []
    for i, text, *_ in docs:
        spans = [(m.start(), n, m.end(), kind) for n, (kind, pattern, part, least) in enumerate(kinds) for m in pattern.finditer(text or "") if len(m[part]) >= least]
        line = ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))
        want.append((i, *(sum(k == kind for *_, k in spans) for kind, *_ in kinds), hashlib.sha256(line.encode()).hexdigest()))
    rows = run(spark, "op9_credential_links", folder)
    assert sorted_rows(want) == sorted_rows((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows)
    text = {i: t for i, t, *_ in docs}
    linked = [r for r in rows if r["doc_id"] is not None and (text[r["doc_id"]] or "").startswith("user_id: worker7")]
    assert [re.sub(r":\d+", "", r["spans"]) for r in linked] == ["weak_id,weak_secret,endpoint"]
    alone = [r for r in rows if r["doc_id"] is not None and (text[r["doc_id"]] or "").startswith("Zx9Zx9")]
    assert [r["spans"] for r in alone] == [""]


def test_op9_many_matches_and_clashing_names(spark):
    from pyspark.sql import functions as F

    from memgrid.llm import secret_scan

    names = ["_base", "_spans", "_weak", "_ids", "_secrets", "base", "spans", "weak", "ids", "secrets", "doc"]
    text = " ".join(f"token=abcdefgh{k}" for k in range(1000))
    docs = spark.createDataFrame([(1, text, *names), (2, "clean", *names), (3, None, *names)], ["doc_id", "text", *names])
    out = secret_scan.redacted(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and got[1]["text"] == " ".join(["[SECRET]"] * 1000) and got[2]["text"] == "clean" and got[3]["text"] is None
    assert all(tuple(r[2:]) == tuple(names) for r in got.values())
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scanned(docs).select("doc.doc_id", "spans").collect()}
    assert [(s["start"], s["end"]) for s in spans[1]] == [m.span() for m in re.finditer(r"\S+", text)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_on_driver_tables(spark, name):
    from compare import DATA, assert_same

    assert_same(Q[name](spark, DATA), registry.oracle_sql()[name])


def test_op10_pages(spark, folder):
    rows = sorted((r["page_id"], r["text"], r["n_chars"]) for r in run(spark, "op10_html_text", folder))
    assert rows == [(1, "a & b", 5), (2, "", 0), (3, "", 0), (3, "plain", 5), (4, "deep", 4)]


PAGE = """<html><head><title>t</title></head><body><header><a href=x>Home</a></header><div id="cookie-notice">We use cookies, all, of, them.</div>
<div class="sidebar"><p>Side, text, with, commas, and more of it to look like an article.</p></div>
<div class="content"><article><h1>Head</h1><p>One, two &amp; three.</p><div class="ad-box">Buy, now.</div><section><p>Next
part.<p>Last <b>bold</b> part.</section><form><p>Mail?</p></form><section id="comments"><p>Nice, post, really, so, good.</p></section></article></div>
<footer>Foot</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_op10_leaves_furniture_out():
    from memgrid.llm.html_text import extracted

    assert extracted(PAGE) == "Head One, two & three. Next part. Last bold part."


PAGES = {
    "names that only sound like furniture": (
        "<body><nav><a href=a>A</a></nav><article><header><h1>The title, of it</h1></header><p>First part of the text, with commas, and more.</p>"
        "<section class='social-history'><p>Customs of the time, at length, were kept by all, and told for long.</p></section>"
        "<section id=legal-background><p>The law, as it stood, was this, and none had changed it in years.</p></section><aside><p>Quoted words, set apart, of the same story, and its people.</p></aside></article></body>",
        "The title, of it First part of the text, with commas, and more. Customs of the time, at length, were kept by all, and told for long. "
        "The law, as it stood, was this, and none had changed it in years. Quoted words, set apart, of the same story, and its people.",
    ),
    "no article element": (
        "<body><div id=top><a href=x>Home</a> <a href=y>News</a></div><div class=page><div class=left><p>Short, side.</p></div><div class=c1><h2>Head</h2><p>Long text, with commas, one after another, "
        "and so on, until it is long enough to count.</p><p>Second, as long, as the first, more or less, and with as many commas, too.</p><p>End</p></div></div>"
        "<div><p>We use cookies, as all do.</p><button>Yes</button></div><div class=footer>Imprint</div></body>",
        "Head Long text, with commas, one after another, and so on, until it is long enough to count. Second, as long, as the first, more or less, and with as many commas, too. End",
    ),
    "sections in wrappers": (
        "<main><div class=w><section><div><p>" + "One, two, three, four. " * 6 + "</p></div></section><section><div><p>" + "Five, six, seven, eight. " * 6 + "</p></div></section><section><div><p>"
        + "Nine, ten, eleven, twelve. " * 6 + "</p></div></section></div></main><div class=comment-list><p>" + "Nice, good, and so on, again. " * 9 + "</p></div>",
        ("One, two, three, four. " * 6 + "Five, six, seven, eight. " * 6 + "Nine, ten, eleven, twelve. " * 6).strip(),
    ),
    "bare paragraphs": ("<html><body><div class=menu><a href=a>A</a></div><h1>T</h1><p>One, two.</p><p>Three</p><div class='ad'>Buy, now, all, of it.</div></body></html>", "T One, two. Three"),
}


@pytest.mark.parametrize("name", PAGES)
def test_op10_points_decide(name):
    from memgrid.llm.html_text import extracted

    page, want = PAGES[name]
    assert extracted(page) == want


def test_op10_deep_pages_take_linear_time():
    import time

    from memgrid.llm.html_text import extracted

    def took(n):
        at = time.perf_counter()
        assert extracted("<div>x, y" * n + "<p>deep</p>").endswith("deep")
        return time.perf_counter() - at

    took(1000)
    assert took(16_000) < 40 * took(2000)


def test_op10_driver_pages(spark):
    import html

    text = {r["page_id"]: r["text"] for r in run(spark, "op10_html_text", "/root/testdata/sf0.001")}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", body)]
        assert text[r["page_id"]] == " ".join(x for x in parts if x)
