"""MaxScore, mixing, licences, the classifier and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import licences, maxscore, mixing, neighbours, stages
from tests.conftest import SF, same_rows


def brute_top(rows, k=5):
    import math

    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


@pytest.mark.parametrize("block,queries", [(4096, 2048), (7, 2)])
def test_maxscore_is_exact(spark, block, queries):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.3, 16)]) for i in range(400)]
    rows += [(400, rows[50][1]), (401, rows[50][1]), (450, None), (500, [None] * 16), (550, [float("nan")] * 16), (551, [float("inf")] * 16), (600, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = maxscore.top_k(df, F.col("vec_id") % 50 == 0, candidate_block=block, query_block=queries).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(rows))


def test_maxscore_reads_less_than_everything():
    r = np.random.default_rng(2)
    scale = np.geomspace(1000, 1, 32)
    block = (r.normal(0, 1, (4000, 32)) * scale).astype(np.int64)
    best = maxscore.Best(1, 5)
    read = maxscore.search_block(np.array([-1]), block[:1], np.arange(2000), block[:2000], best) + maxscore.search_block(np.array([-1]), block[:1], np.arange(2000, 4000), block[2000:], best)
    s = block @ block[0]
    assert [-x for x, _ in best.of[0]] == sorted(s.tolist(), reverse=True)[:5]
    assert read < 0.75 * 4000 * 32


def test_maxscore_of_huge_components(spark):
    rows = [(0, [1e30, -2.0]), (50, [3e17, 0.5]), (1, [1e30, 5.0]), (2, [-1e300, 1.0]), (3, [1e10, 1.0]), (4, [2.0**40, 3.0]), (5, [0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = sorted((q, n + 1, i, -x) for q, _, _, _ in brute_top(rows) for n, (x, i) in enumerate(sorted((clip(a[3]) * -1, a[2]) for a in brute_top(rows, k=9) if a[0] == q)[:5]))
    assert sorted(map(tuple, maxscore.top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(set(want))


def test_maxscore_of_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in maxscore.top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert maxscore.top_k(two.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_sql_of_search_and_mixing(spark, duck):
    from lotwise.llm import entry

    for name, sql in entry.oracle_sql().items():
        same_rows(entry.queries()[name](spark, SF), duck.sql(sql))


def budgets(leaves, total, epochs, weights):
    """Water-filling by repeated sharing, top down."""

    def fill(given, children):
        got, open_ = {c: 0.0 for c in children}, {c for c, (cap, w) in children.items() if w > 0}
        while open_ and given > 1e-9:
            w = sum(children[c][1] for c in open_)
            full = {c for c in open_ if children[c][0] <= given * children[c][1] / w + 1e-9}
            if not full:
                for c in open_:
                    got[c] = given * children[c][1] / w
                return got
            for c in full:
                got[c] = children[c][0]
                given -= children[c][0]
            open_ -= full
        return got

    weight = lambda p: weights.get("/".join(p), 1)
    cap = lambda prefix: sum(t * epochs for p, t in leaves.items() if p[: len(prefix)] == prefix and all(weight(p[: i + 1]) > 0 for i in range(len(p))))

    def down(prefix, given):
        if len(prefix) == len(next(iter(leaves))):
            return {prefix: given}
        kids = {p[: len(prefix) + 1] for p in leaves if p[: len(prefix)] == prefix}
        return {k: v for c, g in fill(given, {c: (cap(c), weight(c)) for c in kids}).items() for k, v in down(c, g).items()}

    return down((), min(total, cap(())))


def test_mixing_budgets_and_prefixes(spark):
    r = random.Random(4)
    rows = []
    for i in range(700):
        d = r.choice("abc")
        rows.append((i if i % 97 else None, d, r.choice(["en", "de", None]), f"s{r.randrange(3)}", r.choice([0, 1, 5, 30, 400])))
    rows += [(1000, "d", "en", "s0", 5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long").withColumn("bucket", F.lit("mine"))
    weights = {"a": 6, "b": 3, "c": 1, "d": 2, "a/en": 5, "b/de": 0}
    total = sum(x[4] for x in rows)
    got = mixing.mix(df, weights=weights, budget_tokens=total, max_epochs=2, bucket_docs=20).collect()
    leaves = {}
    for _, d, lang, s, n in rows:
        leaves[d, lang or "", s] = leaves.get((d, lang or "", s), 0) + n
    want = budgets(leaves, total, 2, weights)
    taken = {}
    for x in got:
        key = (x["domain"], x["lang"] or "", x["source"])
        taken[key] = taken.get(key, 0) + x["take_tokens"]
        assert x["epoch"] < 3 and x["bucket"] == "mine" and 0 <= x["take_tokens"] <= x["n_tokens"]
    for k, v in want.items():
        assert abs(taken.get(k, 0) - v) <= 1
    assert not any(k[:2] == ("b", "de") for k in taken)
    assert sum(taken.values()) == pytest.approx(min(total, sum(want.values())), abs=len(leaves))


@pytest.mark.parametrize("sent", [0, mixing.SENT_LEAVES])
def test_mixing_a_key_that_most_rows_have(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "SENT_LEAVES", sent)
    rows = [(7, "d", "en", "s", 3)] * 400 + [(None, "d", "en", "s", 2)] * 50 + [(i, "d", "en", "s", 5) for i in range(100, 160)] + [(i, "e", "en", "s", 5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long").repartition(6)
    for total in (1, 299, 1000, 1601):
        got = mixing.mix(df, weights={}, budget_tokens=total, max_epochs=1, bucket_docs=40).collect()
        taken = [x["take_tokens"] for x in got]
        assert sum(taken) in (total, total - 1) and sum(x["take_tokens"] < x["n_tokens"] for x in got) <= 2


def test_first_tokens(spark):
    texts = ["", None, "a", "  a b\n\tc ", "ü  ü", "x " * 5000]
    df = spark.createDataFrame([(t, n) for t in texts for n in (0, 1, 2, 4000)], "t string, n int")
    for t, n, x in df.select("t", "n", mixing.first_tokens(F.col("t"), F.col("n"))).collect():
        if t is None:
            assert x is None
        else:
            assert t.startswith(x) and x.split() == t.split()[:n]


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, n_tokens long")
    assert mixing.mix(df).count() == 0


def brute_licences(rows, forms, least=0.75, file_share=0.5):
    """Every line, block and whole text against every form, by dictionaries."""
    import math
    import re
    from collections import Counter, defaultdict

    term = lambda t: re.findall(licences.TERM, t.lower())
    damped = lambda c: {k: 1 + math.log(v) for k, v in c.items()}
    listed = [(k, Counter(term(t))) for k, v in sorted(forms.items()) for t in v]
    known = {t for _, c in listed for t in c}
    df = Counter(t for _, x in rows for t in set(term(x or "")) & known)
    idf = lambda t: math.log((len(rows) + 1) / (df[t] + 1)) + 1 if t in known else math.log(len(rows) + 1) + 1
    vector = lambda c: {k: v * idf(k) for k, v in damped(c).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(k, vector(c)) for k, c in listed]
    own, as_file = defaultdict(lambda: (False, 0, "")), defaultdict(lambda: (False, 0, ""))
    for path, text in rows:
        low = (text or "").lower()
        total = len(term(low))
        for unit in {low, *re.split(r"\r?\n(?:[ \t]*\r?\n)+", low), *re.split(r"[\r\n]+", low)}:
            u = vector(Counter(term(unit)))
            if not u:
                continue
            best = max((round(sum(w * v.get(k, 0) for k, w in u.items()) / length(u) / length(v), 9), name) for name, v in vectors)
            if best[0] >= least:
                best = (best[1] != "Proprietary", *best)
                own[path] = max(own[path], best)
                if unit == low or len(term(unit)) / total >= file_share:
                    as_file[path] = max(as_file[path], best)
    directory = lambda p: re.sub("/?[^/]*$", "", p or "")
    at = defaultdict(lambda: (False, 0, ""))
    for p, x in as_file.items():
        at[directory(p)] = max(at[directory(p)], x)
    out = []
    for p, _ in rows:
        d = directory(p)
        above = [d[:i] for i in range(len(d), 0, -1) if i == len(d) or d[i] == "/"] + [""]
        near = next((x for x in above if x in at), None)
        if p in own:
            out.append((p, own[p][2], "own", own[p][1], None))
        elif near is not None:
            out.append((p, at[near][2], "inherited", at[near][1], near))
        else:
            out.append((p, None, "none", None, None))
    return out


def test_licences_match_brute_force(spark):
    r = random.Random(3)
    forms = licences.templates()
    filler = lambda n: " ".join(r.choice(["the", "a", "software", "license", "may", "use", f"word{r.randrange(400)}"]) for _ in range(n))
    wrapped = lambda t, mark="": "\n".join(mark + x for x in t.strip().splitlines())
    mit, apache, bsd = (next(v for v in reversed(forms[k])) for k in ("MIT", "Apache-2.0", "BSD-3-Clause"))
    rows = [
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit), ("a/b/c/code.py", filler(200)), ("a/x/LICENSE", apache.upper()), ("a/x/y/code.py", filler(50)),
        ("bsd/COPYING", "Copyright (c) 2001, Them\nAll rights reserved.\n" + bsd), ("bsd/deep/er/f", filler(9)), ("a/h.c", wrapped(forms["Apache-2.0"][2], "# ") + "\n\nimport x\n" + filler(120)),
        ("a/x/head.py", f"{filler(200)}\nLicensed under the Apache License, Version 2.0.\n{filler(200)}"), ("gpl/main.c", wrapped(forms["GPL-3.0"][1], " * ") + "\n\n" + filler(90)),
        ("other/code.py", filler(200)), ("other/none", None), ("other/empty", ""), ("top", filler(30)), (None, None), (None, forms["MIT"][0]), ("", filler(5)),
        ("twice/f", filler(20)), ("twice/f", filler(20) + "\n" + forms["MIT"][0]), ("twice/f", filler(20)), ("long", filler(60_000) + "\nReleased under the MIT License.\n"), ("a/b/../c", "\n\n \n"),
    ]
    rows += [(f"many/{i % 7}/{i}", filler(r.randrange(60)) + (r.choice(["\n", "\n\n", " "]) + r.choice([x for v in forms.values() for x in v if len(x) < 900]) if i % 3 == 0 else "")) for i in range(120)]
    rows += [("many/hot/f", "All rights reserved. " + filler(3))] * 40
    df = spark.createDataFrame(rows, "path string, text string").withColumns({"licence": F.lit(0), "dir": F.lit("x"), "uid": F.lit(1), "term": F.lit("t")}).repartition(5)
    got = [tuple(x) for x in licences.scan(df).collect()]
    want = brute_licences(rows, forms)
    key = lambda x: tuple(map(repr, x))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (g[0], g[1], g[2], g[4]) == (w[0], w[1], w[2], w[4]) and (g[3] is None) == (w[3] is None) and (g[3] is None or abs(g[3] - w[3]) < 1e-6)
    by = {g[0]: g for g in got}
    assert by["a/LICENSE"][1:3] == ("MIT", "own") and by["a/b/c/code.py"][1:3] == ("MIT", "inherited") and by["a/x/LICENSE"][1] == "Apache-2.0" and by["a/x/y/code.py"][4] == "a/x"
    assert by["bsd/deep/er/f"][1:3] == ("BSD-3-Clause", "inherited") and by["a/h.c"][1:3] == ("Apache-2.0", "own") and by["gpl/main.c"][1:3] == ("GPL-3.0", "own") and by["long"][1:3] == ("MIT", "own")
    assert by["other/code.py"][2] == "inherited" and by["other/none"][4] == ""  # the null path's notice is a licence file of the root


def test_whole_licences_of_others_are_found(spark):
    """Texts as they are found on systems, with their own first lines and wraps."""
    from pathlib import Path

    found = [(x.name, x.read_text()) for x in map(Path, ("/usr/share/common-licenses/" + n for n in ("BSD", "GPL-2", "GPL-3", "MPL-2.0", "Apache-2.0", "LGPL-2.1"))) if x.exists()]
    if not found:
        pytest.skip("none here")
    got = {x["path"]: x["licence"] for x in licences.scan(spark.createDataFrame(found, "path string, text string")).collect()}
    want = {"BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0"}
    assert got == {k: want.get(k, k) for k, _ in found}


def test_licences_of_nothing(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert licences.scan(none).count() == 0
    assert [tuple(x) for x in licences.scan(spark.createDataFrame([("a", "b")], "path string, text string"), forms={}).collect()] == [("a", None, "none", None, None)]


def test_licence_query_of_null_ids(spark, tmp_path):
    rows = [(None, "Released under the MIT License.", "en", "s"), (None, "x", None, None), (7, "y", "en", "s"), (7, "y", "en", "s"), (8, None, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["licence"] or "") for x in licences.op9_licence_tfidf(spark, str(tmp_path)).collect())
    assert got == [(False, 7, ""), (False, 7, ""), (False, 8, ""), (True, 0, ""), (True, 0, "MIT")]


def test_classifier_tells_held_out_documents_apart(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + "x" * r.randrange(4) for _ in range(80))
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, bad() if i % 4 == 0 else good(), 0 if i % 4 == 0 else 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held = neighbours.held_out_part()
    voter = neighbours.fit(df.filter(~held).drop("quality"), df, "text", "quality", "doc_id", neighbours.Settings(max_examples=120, dimensions=8, neighbours=7))
    assert len(voter.vectors) == 120
    got = neighbours.classify(df.unionByName(spark.createDataFrame([(900, None, 1), (901, "", 1)], df.schema)), voter, ["doc_id", "quality"]).collect()
    assert all(0 <= x["score"] <= 1 for x in got)
    assert all((x["score"] >= 0.7) == (x["quality"] == 1) for x in got if x["doc_id"] < 900)
    assert {x["score"] for x in got if x["doc_id"] >= 900} == {voter.prior}


def test_votes_are_those_of_all_examples(spark):
    import pyarrow as pa

    r = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 50, 30)) for _ in range(80)]
    df = spark.createDataFrame([(i, t, int(i % 3 > 0)) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    s = neighbours.Settings(dimensions=6, neighbours=5, block=16)
    v = neighbours.fit(df, df, "text", "quality", "doc_id", s)
    own = neighbours._projected(pa.array(texts), v.idf, v.basis)
    cosine = own.astype(float) @ v.vectors.T.astype(float)
    for row, score in zip(cosine, v.scores(pa.array(texts))):
        near = np.argsort(-row)[: s.neighbours]
        w = np.maximum(row[near], 0) ** s.power
        assert score == pytest.approx((w * v.labels[near]).sum() / w.sum(), abs=1e-3)


def test_examples_without_words(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, " ", 1), (3, " ", 1)], "doc_id long, text string, quality int")
    v = neighbours.fit(df, df, "text", "quality", "doc_id")
    assert {x["score"] for x in neighbours.classify(df, v, ["doc_id"]).collect()} == {2 / 3}  # the repeated row is one example


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, quality int")
    assert neighbours.fit(df, df, "text", "quality", "doc_id") is None
    assert neighbours.classify(df, None, ["doc_id"]).first()["score"] == 0.5


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    given = docs.unionByName(extra).withColumns({"score": F.lit("x"), "epoch": F.lit(1), "_key": F.lit(0)})
    kept = stages.near_duplicates(spark, given, SF)
    assert kept.columns == list(stages.COLUMNS)
    assert kept.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    clean = stages.decontaminated(spark, given, SF)
    from lotwise.llm import decontaminate

    hit = {r[0] for r in decontaminate.matches(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct().collect()}
    left = {r[0] for r in clean.select("doc_id").collect()}
    assert hit and not hit & left and {r[0] for r in docs.select("doc_id").collect()} - hit <= left
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "pack_id" and out.count() > 0


@pytest.mark.parametrize("tile", [3, 2000])
def test_near_duplicates_stage_has_similarity_of_five_words(spark, monkeypatch, tile):
    from lotwise.llm import nearcopies

    monkeypatch.setattr(nearcopies, "TILE", tile)
    r = random.Random(11)
    word = lambda: "w" + str(r.randrange(4000))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([60, 150, 300]))]
        texts.append(" ".join(base))
        for _ in range(9):  # a chain of copies, each with a few words changed
            base = [word() if r.random() < r.choice([0.005, 0.02, 0.04]) else w for w in base]
            texts.append(" ".join(base))
    passage = " ".join(word() for _ in range(80))
    texts += [f"{passage} {' '.join(word() for _ in range(60))}" for _ in range(30)]  # one passage is not a copy
    texts += [None, "", "a b", "A  b", "a c", texts[0].upper(), texts[0]]
    rows = list(enumerate(texts)) + [(3, texts[3])]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    want = sorted({root(i) for i in range(len(texts))})
    assert 60 < len(want) < 140
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = [x["doc_id"] for x in stages.near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept) == want


def test_examples_that_no_longer_fit_are_passed_over(spark):
    rows = [(i, "long " * 500 if i % 2 else "short text", i % 2) for i in range(40)] + [(None, "none", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    v = neighbours.fit(df, df, "text", "quality", "doc_id", neighbours.Settings(max_example_bytes=400, dimensions=4))
    assert len(v.vectors) == 20 and set(v.labels) == {0.0}
    empty = df.limit(0)
    assert neighbours.fit(empty, df, "text", "quality", "doc_id") is None and neighbours.classify(empty, v, ["doc_id"]).count() == 0


def test_document_frequencies_are_those_of_all_texts(spark):
    import pyarrow as pa

    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 5))) for i in range(50)] + [(50, None), (51, "x " * 400_000)]
    files, df = neighbours.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    _, term, _ = neighbours.terms_of(pa.array([t for _, t in rows]))
    assert files == 52 and (df == np.bincount(term, minlength=neighbours.TERMS)).all()
