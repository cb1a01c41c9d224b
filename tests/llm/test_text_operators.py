"""The text operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, ngram, packing, repeats, secretscan, simhash

LOW = {i: i + 32 for i in range(65, 91)}
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int, n: int = 60) -> list:
    r = random.Random(seed)
    words = ["the", "Wafer", "réglage", "etch", "plasma", "gas", "Lot", "ÄÖ", "x", "radio-frequency", "0.5", "über"]
    make = lambda k: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(k))
    out = [make(r.choice([0, 1, 2, 3, 5, 40, 90])) for _ in range(n)]
    passage = make(60)
    out += [passage, passage, f"{make(8)}\n{passage}  {make(4)}", passage[:-9] + " changed", None, None, "", " \t\n", "a" * 700, "ab" * 300, make(3000)]
    out += [out[3], out[3].upper()]
    return out


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    t = texts(1)
    rows = list(enumerate(t)) + [(3, t[3])]
    return rows, table(spark, rows).withColumns({"k": F.lit(1), "h": F.lit("x"), "n": F.lit(2.0)})


def brute_fingerprint(text) -> int:
    w = SPACE.findall((text or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict) -> dict:
    ids, parent = list(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(docs):
    rows, df = docs
    got = simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal().alias("f"), "component_id").collect()
    fps = {d: brute_fingerprint(t) for d, t in rows}
    roots = brute_components(fps)
    assert len(got) == len(rows)
    assert all(r["f"] == format(fps[r["doc_id"]], "016x") and r["component_id"] == roots[r["doc_id"]] for r in got)


@pytest.mark.parametrize("tree_size,chunk_size", [(4096, 65536), (3, 5), (1, 2)])
def test_links_do_not_depend_on_how_shards_are_cut(spark, tree_size, chunk_size):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) for b in base for _ in range(25)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.fingerprint_links(table(spark, [(v,) for v in signed], "fp long"), 3, tree_size, chunk_size).collect()
    mask = (1 << 64) - 1
    want = brute_components({v & mask: v & mask for v in signed})
    parent = {v: v for v in want}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = find(e["a"] & mask), find(e["b"] & mask)
        parent[max(a, b)] = min(a, b)
    assert {v: find(v) for v in want} == want


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(5)
    values = [r.getrandbits(10) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_empty_tables(spark):
    e = table(spark, [])
    assert simhash.near_duplicates(e).count() == 0
    assert repeats.repeated_spans(e).count() == 0
    assert secretscan.scan(e).count() == 0
    assert packing.pack(e).count() == 0
    assert ngram.score(e, ngram.train(e), F.lit(True)).count() == 0
    items = table(spark, [], "item_id long, text string")
    assert decontaminate.matches(e, items).count() == 0


def test_language_model_matches_brute_force(docs):
    rows, df = docs
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    got = {(r["doc_id"], i): r for i, r in enumerate(ngram.score(df, ngram.train(df.filter(~held)), held).collect())}
    token = {i: [*SPACE.findall((t or "").translate(LOW)), None] for i, (d, t) in enumerate(rows)}
    out = {i: zlib.crc32(str(d).encode()) % 5 == 1 for i, (d, _) in enumerate(rows)}
    uni, pair = collections.Counter(), collections.Counter()
    for i, t in token.items():
        if not out[i]:
            uni.update(t)
            pair.update(zip(["<s>", *t[:-1]], t))
    n, v, cont = sum(uni.values()), len(uni), collections.Counter(w for _, w in pair)
    of = lambda c: [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
    d, e = (0, *ngram.discounts(*of(pair))), (0, *ngram.discounts(*of(cont)))
    left = sum(e[min(x, 3)] for x in cont.values()) / len(pair)
    total, gamma = collections.Counter(), collections.Counter()
    for (a, _), c in pair.items():
        total[a] += c
        gamma[a] += d[min(c, 3)]

    def p(a, w):
        single = max(cont[w] - e[min(cont[w], 3)], 0) / len(pair) + left / (v + 1)
        return (max(pair[a, w] - d[min(pair[a, w], 3)], 0) + gamma[a] * single) / total[a] if total[a] else single

    for i, (doc, _) in enumerate(rows):
        t = token[i]
        r = next(x for (k, _), x in got.items() if k == doc)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(uni[w] > 0 for w in t), n)
        assert r["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t[:-1]], t)), abs=1e-6)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
    for a in ["<s>", "etch3", "never seen"]:
        assert sum(p(a, w) for w in uni) + p(a, "unknown") == pytest.approx(1.0)


def test_repeats_match_brute_force(docs):
    rows, df = docs
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_spans(df).collect())
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
    want = collections.Counter()
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[d, len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_maximal_repeats_give_all_occurrences():
    body = [b"xAAAABBBBy", b"zAAAABBBBw", b"xAAAABBBBq", b"AAAACCCC"]
    right = [b[b.index(b"AAAA") :][:8] for b in body]
    left = [b[: b.index(b"AAAA")][::-1] for b in body]
    groups = {(tuple(sorted(m)), q, p) for m, q, p in repeats.maximal_repeats(left, right, 8, 4)}
    assert ((0, 1, 2), 0, 8) in groups  # AAAABBBB, told apart on both sides
    assert ((0, 2), 1, 8) in groups  # with the x before it
    assert len(groups) == 2


def test_interval_tree():
    assert list(repeats.intervals([2, 3, 1, 0, 4], 1)) == [(3, 1, 2), (2, 0, 2), (1, 0, 3), (4, 4, 5)]


def test_packing_round_trip(docs):
    rows, df = docs
    packs = packing.pack(df, capacity=64, block_tokens=500).collect()
    parts = collections.defaultdict(list)
    for p in packs:
        assert p["n_tokens"] <= 64 and p["cu_seqlens"][0] == 0 and p["cu_seqlens"][-1] == p["n_tokens"] == len(p["input_ids"])
        for i, (k, piece) in enumerate(zip(p["keys"], p["pieces"])):
            a, b = p["cu_seqlens"][i : i + 2]
            parts[k].append((piece, tuple(p["input_ids"][a:b])))
            assert p["position_ids"][a:b] == list(range(b - a))
    encode = packing._encoding(packing.VOCABULARY, packing.PATTERN).encode_ordinary
    for d, t in rows:
        n = sum(x == d for x, _ in rows)
        want = encode(t or "")
        pieces = collections.Counter({(i, tuple(want[i * 64 : i * 64 + 64])): n for i in range(-(-len(want) // 64))})
        assert collections.Counter(parts[d]) == pieces


def test_binary_matrices(spark, docs, tmp_path):
    import numpy as np

    packs = packing.pack(docs[1], capacity=64, block_tokens=500).cache()
    packing.write_binary(packs, f"{tmp_path}/packs", capacity=64, pad=7)
    back = {r["pack_id"]: r for r in spark.read.parquet(f"{tmp_path}/packs").collect()}
    want = packs.collect()
    assert len(back) == len(want) > 20
    for p in want:
        ids, positions, cuts = (np.frombuffer(back[p["pack_id"]][x], "<i4").tolist() for x in ("input_ids", "position_ids", "cu_seqlens"))
        n = p["n_tokens"]
        assert ids == p["input_ids"] + [7] * (64 - n) and positions == p["position_ids"] + [0] * (64 - n) and cuts == p["cu_seqlens"]
    packing.write_binary(packs.limit(0), f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_pieces_that_share_a_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lotwise.llm.bytestext import buffers

    monkeypatch.setattr(packing, "segment_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    coder = packing.Ids(packing.VOCABULARY, packing.PATTERN)
    some = ["one two one", "two  three", "", "one"]
    ids, n = coder.of(*buffers(pa.array(some)))
    assert ids.tolist() == [x for t in some for x in coder.encode(t)] and n.tolist() == [len(coder.encode(t)) for t in some]


def test_ids_are_those_of_the_whole_text():
    import pyarrow as pa

    from lotwise.llm.bytestext import buffers

    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "b1", " ", "　", " ", "\u0085", ".", "'s", "ß", "漢", "\x1c", "🙂", "!!"]
    some = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)]
    coder, at = packing.Ids(packing.VOCABULARY, packing.PATTERN), 0
    ids, n = coder.of(*buffers(pa.array(some)))
    for t, k in zip(some, n.tolist()):
        assert ids[at : at + k].tolist() == coder.encode(t)
        at += k


def test_best_fit_decreasing_takes_the_tightest_bin():
    import numpy as np

    r = random.Random(2)
    sizes = np.array([r.randrange(1, 65) for _ in range(400)])
    bins = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(400))
    free: list[int] = []
    for n in sorted(sizes.tolist(), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(64 - n)
    assert sorted(free) == sorted(64 - int(sizes[b].sum()) for b in bins)


KEY_DER = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))  # an Ed25519 key in PKCS#8


def test_secrets(spark):
    import base64
    import json

    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256'})}.{url({'sub': '1'})}.c2ln"
    der, bad = base64.b64encode(KEY_DER).decode(), base64.b64encode(KEY_DER[:-3] + b"abcdef").decode()
    rows = [
        (1, 'é API_KEY = "abcdef12" and token:abc, Password="x" passwd=longenough'), (2, "AKIA" + "A" * 16 + " AKIASHORT"), (3, "0123456789abcdef01234567 0123456789abcdef0123456"),
        (4, f"ß {der} {bad}"), (5, KEY_DER.hex()), (6, f"see {jwt}, not {url({'typ': 'x'})}.{url({})}.c2ln"), (7, f"-----BEGIN PRIVATE KEY-----\n{der}\n-----END PRIVATE KEY-----"), (8, None), (9, ""), (None, "secret: s3cr3tvalue"),
    ]
    got = {r["doc_id"]: r for r in secretscan.scan(table(spark, rows)).collect()}
    assert (got[1]["n_assign"], got[2]["n_access"], got[3]["n_hex"]) == (2, 1, 1)
    first, last = (rows[0][1].index(x) for x in ("API_KEY", "passwd"))
    spans = f"assign:{first}:{first + 19},assign:{last}:{last + 17}"
    assert got[1]["spans"] == spans
    assert got[4]["spans"] == f"der:2:{2 + len(der)}"
    assert got[5]["spans"] == f"hex:0:{2 * len(KEY_DER)},der:0:{2 * len(KEY_DER)}"
    assert got[6]["spans"] == f"jwt:4:{4 + len(jwt)}"
    assert got[7]["spans"].split(",")[0].startswith("pem:0:") and "der:" in got[7]["spans"]
    assert got[8]["spans"] == got[9]["spans"] == "" and got[8]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["n_assign"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


def test_keys_in_the_url_alphabet():
    import base64

    rows = [base64.urlsafe_b64encode(KEY_DER[:16] + bytes((x * 7 + i) % 256 for x in range(32))).decode() for i in range(256)]
    rows = [k for k in rows if "-" in k or "_" in k][:20]
    assert len(rows) == 20
    for k in rows:
        for text in (k, f"key={k.rstrip('=')} and more", f"a {k}\nhello there"):
            at = text.index(k.rstrip("="))
            assert any(kind == "der" and s == at for kind, s, _ in secretscan.confirmed(text))
        assert not any(kind == "der" for kind, _, _ in secretscan.confirmed(k[4:]))


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_of_random_rows(spark, seed):
    """Rows of the alphabets without breaks between them, in one batch: as the patterns give them text by text."""
    r = random.Random(seed)
    some = lambda: r.choice(["0123456789abcdef" * r.randrange(1, 4), "AKIA" + "A1" * r.randrange(5, 12), "token=" + "x" * r.randrange(3, 9), "é", " ", "\n", "Password\": 'abc123/+", "ABC", "-", "f" * r.randrange(20, 30), "api_key:" + "Z" * 6, ""])
    rows = [(i, "".join(some() for _ in range(r.randrange(5)))) for i in range(300)] + [(300, None), (301, "word " * 100_000 + "a0" * 15)]
    got = {x["doc_id"]: x for x in secretscan.scan(table(spark, rows).coalesce(1)).collect()}
    for i, t in rows:
        base = [("assign", m) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[2]) >= 6]
        base += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [("hex", m) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 24]
        order = {"assign": 0, "access": 1, "hex": 2}
        listed = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in sorted(base, key=lambda x: (x[1].start(), order[x[0]])))
        x = got[i]
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(k == n for k, _ in base) for n in order)
        assert x["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(x["spans"].split(","))


def test_secrets_of_adjacent_rows_without_breaks():
    """Rows that are one run of an alphabet from end to end, as copies of a bare hash or token are."""
    import base64
    import json

    import pyarrow as pa

    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    digest, jwt = "0123456789abcdef" * 2, f"{url({'alg': 'HS256'})}.{url({'sub': '1'})}.c2ln"

    def spans(rows):
        b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["k", "t"])
        return [(n, x) for out in secretscan._scan([b]) for n, x in zip(out.column(3).to_pylist(), out.column(5).to_pylist())]

    assert spans([digest] * 5) == [(1, "hex:0:32")] * 5
    assert spans(["Some prose here.", jwt, "Other prose here."]) == [(0, ""), (0, f"jwt:0:{len(jwt)}"), (0, "")]
    assert spans(["", digest, None, "", digest, digest[:20], digest[:20], ""]) == [(0, ""), (1, "hex:0:32"), (0, ""), (0, ""), (1, "hex:0:32"), (0, ""), (0, ""), (0, "")]
    assert spans([digest]) == [(1, "hex:0:32")] and spans(["", None]) == [(0, "")] * 2


def test_keys_next_to_lines_of_the_alphabet():
    import base64

    key = base64.b64encode(KEY_DER).decode()
    assert len(KEY_DER) % 3 == 0 and "=" not in key
    n = len(key)
    one = [("der", 0, n)]
    assert secretscan.confirmed(key) == one
    assert secretscan.confirmed(key + "\nHello world") == secretscan.confirmed(key + "\r\n\r\nHello\nworld 1") == one
    assert secretscan.confirmed(f"{key}\n{key}\n{key}") == [("der", 0, n), ("der", n + 1, 2 * n + 1), ("der", 2 * n + 2, 3 * n + 2)]
    wrapped = f"{key[:44]}\n{key[44:]}"
    assert secretscan.confirmed(f"{wrapped}\nand more") == [("der", 0, n + 1)]
    assert secretscan.confirmed("a" * 44 + f"\n{wrapped}\nand more") == [("der", 45, n + 46)]
    padded = base64.b64encode(bytes.fromhex("302f020100300506032b657004230421") + bytes(range(33))).decode()
    assert padded.endswith("=") and secretscan.confirmed(padded + "\nHello") == [("der", 0, len(padded))]
    assert secretscan.confirmed(key[:-8] + "\nHello world") == []


def test_decontamination_matches_brute_force(spark):
    r = random.Random(7)
    word = lambda: "w" + str(r.randrange(400))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([16, 24, 40, 3, 5, 60])] + [(90, None), (91, "")]
    rows = []
    for d in range(60):
        w = [word() for _ in range(r.randrange(0, 150))]
        own = (items[d % 6][1]).split()
        if d % 3 == 0:
            own = own[: r.randrange(1, len(own) + 1)] if d % 2 else own
            if d % 4 == 0 and len(own) > 20:
                own[len(own) // 2] = "new"
            w[r.randrange(len(w) + 1) : 0] = own
        rows.append((d, " ".join(w).upper() if d % 5 else " ".join(w) + "!"))
    rows += [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1]), (None, items[1][1])]
    for d in range(200, 260):  # items with words moved, put in, left out, changed or said twice, in other text
        w = items[r.choice([1, 2, 5])][1].split()
        for _ in range(r.randrange(1, 4)):
            i, j = sorted((r.randrange(len(w)), r.randrange(len(w))))
            how = r.randrange(5)
            w = w[j:] + w[:j] if how == 0 else w[:i] + ["put", "in"] + w[i:] if how == 1 else w[:i] + w[i + 1 :] if how == 2 else w[:i] + ["new"] + w[i + 1 :] if how == 3 else w[:i] + w[i : i + 3] + w[i:]
        rows.append((d, " ".join([word() for _ in range(r.randrange(60))] + w + [word() for _ in range(r.randrange(60))])))
    swapped = items[5][1].split()
    rows += [(300, " ".join([word() for _ in range(40)] + swapped[30:] + swapped[:30] + [word() for _ in range(40)])), (301, (items[2][1] + " ") * 70), (302, " ".join(["same"] * 400))]
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.matches(table(spark, rows).withColumn("n", F.lit(1)), table(spark, items, "item_id long, text string")).collect()}

    def shingles(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    want = {}
    for d, t in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        for i, s in items:
            q = (s or "").split()
            for at in range(max(1, len(w) - len(q) + 1)) if q and w else []:
                a, b = shingles(w[at : at + len(q)]) if len(q) >= 5 else collections.Counter([tuple(w[at : at + len(q)])]), shingles(q)
                both = sum((a & b).values())
                j = both / (sum(a.values()) + sum(b.values()) - both)
                if j >= 0.8:
                    want[d, i] = max(j, want.get((d, i), 0))
    assert set(got) == set(want) and (300, 5) in want and sum(d >= 200 for d, _ in map(lambda x: (x[0] or 0, x[1]), want)) > 10
    assert all(got[k] == pytest.approx(want[k]) for k in got)
