"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns with clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from vecspark.llm import embedding_dedup, license_scans, line_dedup, mixing, packing, quality_rules, sharding, simhash_dedup, suffix_dedup, url_filters
from vecspark.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARA = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, "   \n\t ", "en", "b", 6),
    (4, PARA + "\nshort line", "en", "a", 1),
    (5, PARA + "\nanother end", "en", "a", 1),
    (6, PARA + "\nshort line", "en", "c", 1),
    (6, PARA + "\nshort line", "en", "c", 1),
    (7, "word " * 20000, "en", "b", 1),
    (8, "x" * 40000, "en", "b", 1),
    (None, "Licensed under the Apache License, Version 2.0. " + "filler text here " * 30, "en", "b", 1),
    (9, "Été où naïve ÀÉ 東京 <|endoftext|> it's 12   done\r\n" * 9, "fr", "é", 1),
    (10, "The MIT License\n" + " ".join(f"w{i}" for i in range(300)), "en", None, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


INSIDE = """key size fp n_words shard _id_ id at gone batch length _id _source _size _shard _gone _of _keep _take _from k1 k2 all numbers removed _removed
row none n source_size spans passes take words from order seeded crc part a b best first place target low whole e w h in0 in1 body _body take rest n_shards no
host path label node vec cell t home other lo hi blk piece start offset sequence_id fail_bits kept taken text_crc32 slot law component_id fingerprint _row""".split()


def clashing(df, upper=False):
    """The table with more columns whose names the operators use inside."""
    return df.select("*", *(F.lit(1).alias(n.upper() if upper else n) for n in dict.fromkeys(INSIDE)))


SMALL = {
    "op1": license_scans.scan,
    "op3": mixing.mix,
    "op4": simhash_dedup.near_dedup,
    "op5": line_dedup.dedup,
    "op6": quality_rules.ledger,
    "op7": suffix_dedup.dedup,
    "op8": lambda d: sharding.shard(d, [1.0] * 4, [1.0] * 5),
    "op9": packing.pack_documents,
}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_empty_and_clashing(spark, odd, name):
    f = SMALL[name]
    assert f(spark.createDataFrame([], DOCS)).count() == 0
    plain = f(odd)
    at = [i for i, c in enumerate(plain.columns) if c not in ("slot", "sequence_id", "offset", "_removed")]
    want = Counter(tuple(r[i] for i in at) for r in plain.collect())
    for upper in (False, True):
        assert Counter(tuple(r[i] for i in at) for r in f(clashing(odd, upper)).collect()) == want


# ---- 1


def license_brute(text):
    words = re.findall(license_scans.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scans.BASE.items():
        p = phrase.split()
        hit = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hit
        if hit:
            labels.add(label)
    added = set()
    postings, sizes = license_scans.index()
    votes = Counter((no, i - at) for i, w in enumerate(words) for no, at in postings.get(w, []))
    for (no, start), n in votes.items():
        label, notice, phrase = license_scans.NOTICES[no]
        notice, phrase = notice.split(), phrase.split()
        at = start + next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
        if n >= math.ceil(license_scans.MIN_VOTES * sizes[no]) and at >= 0 and words[at : at + len(phrase)] == phrase:
            added.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | added))


@pytest.mark.parametrize("table", ["odd", "real"])
def test_license_scans(request, table):
    df = request.getfixturevalue(table)
    want = Counter((i, *license_brute(t)) for i, t in rows(df))
    out = license_scans.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in out) == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in out)


def test_license_notices_are_found(spark):
    texts = [(i, "some words before " + notice.upper() + " and after") for i, (_, notice, _) in enumerate(license_scans.NOTICES)]
    got = {r.doc_id: r.labels.split(",") for r in license_scans.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(license_scans.NOTICES[i][0] in labels for i, labels in got.items())


# ---- 2


def embedding_brute(data):
    """(id, n_links, component_id, kept) by row: all pairs by cosine, components by flooding."""
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    n = len(data)
    near = [[j for j in range(n) if j != i and fine(data[i][1]) and fine(data[j][1]) and len(data[i][1]) == len(data[j][1]) and cosine(data[i][1], data[j][1]) >= 0.9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        out.append((data[i][0], len(near[i]), least, data[i][0] == least))
    return Counter(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup(spark, kind):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(80, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.05
    x = np.concatenate((base, near, base[:10], base[5:6] * 3)).astype(np.float32)
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = len(data)
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [3.0], [5.0], [-2.0]]
    mixed = [[1, 0], [1, 0.01], [0, 1], [1, 0, 0], [1, 0.01, 0], [1e200, 1e200, 0], [2e200, 2e200, 0], [1e-30, 0]] if kind == "double" else [[1, 0], [1, 0.01], [0, 1], [1, 0, 0], [1, 0.01, 0], [1e30, 1e30, 0], [2e30, 2e30, 0]]
    data += [(n + i, v if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(odd + mixed)]
    data += [(None, data[0][1]), (None, [0.5, -1.0, 2.0, 7.0]), (3, data[3][1]), (3, data[3][1]), (-9, data[41][1])]
    data = [(i, v if v is None or kind == "double" else [c if c is None else float(np.float32(c)) for c in v]) for i, v in data]
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").repartition(3).select("*", *(F.lit(1).alias(c) for c in ("label", "w", "node", "id", "vec", "k1", "n")))
    assert Counter(tuple(r) for r in embedding_dedup.near_dedup(df).collect()) == embedding_brute(data)
    assert embedding_dedup.near_dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [16, 64, 768])
@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_embedding_recall_at_the_threshold(dim, blocks):
    rng = np.random.default_rng(6)
    a, r = rng.normal(size=(2, 1000, dim))
    a = embedding_dedup._unit(a)
    r = embedding_dedup._unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + math.sqrt(1 - 0.81) * r
    met = np.zeros(len(a), bool)
    for t in range(embedding_dedup.tables_for(dim, blocks)):
        met |= embedding_dedup._met(embedding_dedup.table_cells(a, blocks, t), embedding_dedup.table_cells(b, blocks, t))
    assert met.mean() >= 0.9


def test_embedding_work_grows_slowly():
    """The candidates of unrelated vectors: a block more makes them far fewer."""
    x = embedding_dedup._unit(np.random.default_rng(8).normal(size=(20000, 64)))

    def work(blocks):
        cells = embedding_dedup.table_cells(x, blocks, 0)
        own = Counter(cells[:, 0].tolist())
        return embedding_dedup.tables_for(64, blocks) * sum(own[c] for c in cells.reshape(-1).tolist()) / len(x)

    assert work(2) - embedding_dedup.tables_for(64, 2) < (work(1) - embedding_dedup.tables_for(64, 1)) / 4
    assert [embedding_dedup.blocks_for(n) for n in (0, 1 << 17, (1 << 17) + 1, 1 << 22, 1 << 30)] == [1, 1, 2, 2, 4]


def test_embedding_with_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ONE_BLOCK", 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 16))
    x = np.concatenate((x, x[:30] + 0.05 * rng.normal(size=(30, 16))))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    assert Counter(tuple(r) for r in embedding_dedup.near_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()) == embedding_brute(data)


def test_embedding_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HOT", 20)
    rng = np.random.default_rng(7)
    x = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.05
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_dedup(df).collect()}
    assert [got[i] for i in range(150)] == want.tolist()


# ---- 3


@pytest.mark.parametrize("shard_rows", [mixing.SHARD_ROWS, 40])
def test_mixing(real, odd, monkeypatch, shard_rows):
    monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
    for df in (real, odd):
        out = mixing.mix(df).collect()
        assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(df.repartition(5)).collect()))
        size = {k: 0 for k in {r.source for r in df.collect()}}
        for r in df.collect():
            size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        names = sorted(k for k in size if k is not None) + [None] * (None in size)
        goal = dict(zip(names, mixing.targets([size[k] for k in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
        assert sum(goal.values()) == pytest.approx(sum(size.values())) or all(goal[k] == 3 * size[k] for k in names)
        source = defaultdict(set)
        for r in df.collect():
            source[r.doc_id].add(r.source)
        took = defaultdict(int)
        for r in out:
            assert r.taken <= 3 * r["size"] and r["source_size"] in {size[s] for s in source[r.doc_id]}
            took[next(iter(source[r.doc_id]))] += r.taken
        for k in names:
            assert abs(took[k] - goal[k]) <= max(2 * mixing.BLOCK, 0.03 * goal[k])


def test_targets_and_seats():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000], [5, 1]) == [30.0, 980.0]
    votes, most = [53.0, 24.0, 23.0], [99, 99, 99]
    # Sainte-Lague seat by seat
    for seats in (1, 7, 10, 50):
        got = [0, 0, 0]
        for _ in range(seats):
            got[max(range(3), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(seats, votes, most) == got


def test_mixing_stage_takes_what_the_plan_says(spark, real, odd, monkeypatch):
    """Words come as often as the plan says, also of exact repeats of a row."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    for df in (real, odd.unionByName(odd.where("doc_id = 10")).unionByName(odd.where("doc_id is null"))):
        out = mixing.stage(spark, df, SF)
        assert out.columns == df.columns
        want = Counter()
        for r in mixing.mix(df).collect():
            want[r.doc_id] += r.taken
        got = out.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
        assert {r.doc_id: r.n for r in got if r.n} == {k: v for k, v in want.items() if v}


# ---- 4


def simhash_brute(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


@pytest.mark.parametrize("table", ["odd", "real"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    data = [(i, simhash_brute(t)) for i, t in rows(df)]
    n = len(data)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (data[i][1] ^ data[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if data[i][0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), data[i][0])
    want = Counter((d, f"{h:016x}", least.get(find(i))) for i, (d, h) in enumerate(data))
    assert Counter(tuple(r) for r in simhash_dedup.near_dedup(df).collect()) == want


def test_masks_cover_all_pairs():
    masks = simhash_dedup.masks()
    assert len(masks) == 49 and all(64 - m.bit_count() <= 13 for m in masks)
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a in range(64) for b in range(a))


def test_simhash_chains_and_stage(spark, odd):
    fps = spark.createDataFrame([(i, (1 << i) - 1) for i in range(40)] + [(100, 0b1010101010101 << 40)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash_dedup.groups(fps).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[100] == 100
    kept = simhash_dedup.stage(spark, odd, SF)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and kept.columns == odd.columns
    assert set(ids) == {r.component_id for r in simhash_dedup.near_dedup(odd).collect()}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[100 + i] for i in range(50)}) == 1 and got[0] != got[100]


# ---- 5


def line_brute(data):
    """(id, text, removed): all lines go that lie in a window, from or back from some line, that stands earlier."""
    docs, first = {}, {}
    for doc, text in sorted({(d, t) for d, t in data if d is not None and t is not None}):
        lines = [(i, s) for i, s in enumerate(text.split("\n")) if s.strip(" \t\n\x0b\x0c\r")]
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", s)) for _, s in lines]
        spans = set()
        for a in range(len(lines)):
            ahead = next((b for b in range(a + 1, len(lines) + 1) if sum(n[a:b]) >= line_dedup.WORDS), None)
            back = next((b for b in range(a, -1, -1) if sum(n[b : a + 1]) >= line_dedup.WORDS), None)
            spans |= ({(a, ahead)} if ahead is not None else set()) | ({(back, a + 1)} if back is not None else set())
        docs[doc, text] = lines, spans
        for a, b in sorted(spans):
            first.setdefault(tuple(s for _, s in lines[a:b]), (doc, a))
    out = []
    for doc, text in data:
        lines, spans = docs.get((doc, text), ([], ()))
        gone = set()
        for a, b in spans:
            d, at = first[tuple(s for _, s in lines[a:b])]
            if (d, at) != (doc, a):
                gone.update(i for i, _ in lines[max(a, at + b - a) if d == doc else a : b])
        out.append((doc, "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone) if gone else text, len(gone)))
    return Counter(out)


@pytest.mark.parametrize("table", ["odd", "real"])
def test_line_dedup(request, table):
    df = request.getfixturevalue(table)
    assert Counter((r.doc_id, r.text, r._removed) for r in line_dedup.dedup(df).collect()) == line_brute(rows(df))


def test_line_dedup_of_random_lines(spark):
    """Few different lines in many contexts: blank ones, ones of over WORDS words, runs that continue differently."""
    rng = np.random.default_rng(12)
    pool = ["", "  ", *(" ".join(f"w{rng.integers(30)}" for _ in range(n)) for n in (1, 2, 9, 10, 11, 25, 49, 50, 70, 3, 8))]
    runs = ["\n".join(rng.choice(pool, 12)) for _ in range(6)]
    data = [(int(i), "\n".join([runs[rng.integers(6)] if rng.random() < 0.5 else str(rng.choice(pool)) for _ in range(int(rng.integers(1, 9)))])) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = line_brute(data)
    assert Counter((r.doc_id, r.text, r._removed) for r in line_dedup.dedup(df).collect()) == want and sum(n for _, _, n in want) > 50


def test_line_dedup_selects_minima(spark):
    """Of lines of ten words about one in three is a minimum; all windows are among their extents."""
    df = spark.createDataFrame([(1, "\n".join(" ".join(f"a{i}x{j}" for j in range(10)) for i in range(400)))], "doc_id long, text string")
    found = line_dedup.minima(df, "doc_id", "text").collect()
    assert 100 < len(found) < 180 and {(x["at"], x["len"]) for r in found for x in r.spans} == {(i, 5) for i in range(396)}


def test_line_dedup_of_long_texts_is_linear(spark):
    """No plan in which a lambda holds the expression of a whole column."""
    df = spark.createDataFrame([(1, "\n".join(f"a{i} b{i % 7} c" for i in range(30000))), (2, "\n".join(f"a{i} b{i % 7} c" for i in range(30000)))], "doc_id long, text string")
    assert {r.doc_id: r._removed for r in line_dedup.dedup(df).collect()} == {1: 0, 2: 30000}


def test_line_dedup_keeps_short_repeats(spark):
    run = "\n".join(" ".join(f"{w}{i}" for i in range(10)) for w in "abcdef")
    df = spark.createDataFrame([(1, run), (2, "intro\n" + run + "\noutro"), (3, "a0 a1\nb\n" + run.split("\n")[0])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got[1] == run and got[2] == "intro\noutro" and got[3] == "a0 a1\nb\n" + run.split("\n")[0]


# ---- 6


def quality_brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


@pytest.mark.parametrize("table", ["odd", "real"])
def test_quality_rules(request, table):
    df = request.getfixturevalue(table)
    want = Counter((i, *quality_brute(t)) for i, t in rows(df))
    out = quality_rules.verdict(quality_rules.ledger(df)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(not (r.kept and r.base_failed) for r in out)


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality_rules.verdict(quality_rules.ledger(docs)).join(labels, "doc_id")
    assert out.where("quality = 1 and not base_failed and not kept").count() == 0
    assert out.where("quality = 0 and not kept").count() > 0.8 * out.where("quality = 0").count()


def test_ablation(spark, real):
    led = quality_rules.ledger(real)
    got = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(led).collect()}
    mask = quality_rules.POLICIES[quality_rules.CURRENT]
    bits = [r.fail_bits & mask for r in led.collect()]
    for rule, b in quality_rules.RULES.items():
        want = sum(x >> b & 1 for x in bits), sum(x == 1 << b for x in bits)
        assert got.get(rule, (0, 0)) == want


# ---- 7


def suffix_brute(data):
    seen, out = {}, []
    for doc, text in data:
        b = (text or "").encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], set()).add(math.inf if doc is None else doc)
    for doc, text in data:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if min(seen[b[p : p + 50]]) < (math.inf if doc is None else doc):
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("table", ["odd", "real"])
def test_suffix_dedup(request, table):
    df = request.getfixturevalue(table)
    assert Counter(tuple(r) for r in suffix_dedup.dedup(df).collect()) == suffix_brute(rows(df))


def test_samples_do_not_depend_on_chunks(monkeypatch):
    buf = np.frombuffer(("abc def ghi " * 40 + PARA * 4).encode(), np.uint8)
    ends = np.array([200, 230, 700, len(buf)])
    want = [x.tolist() for x in suffix_dedup.samples(buf, ends)]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    assert [x.tolist() for x in suffix_dedup.samples(buf, ends)] == want


# ---- 8


def rendezvous_brute(doc, n):
    h = hashlib.md5(f"{sharding.SEED}:{'null' if doc is None else doc}".encode()).hexdigest()
    a, b, p = int(h[:7], 16), int(h[7:14], 16), sharding.PRIME
    u = [((a + x) % p) ** 2 % p * ((b + y) % p) % p for x, y in sharding.constants(n)]
    return max(range(n), key=lambda s: (-1 / math.log((u[s] + 0.5) / p), -s))


@pytest.mark.parametrize("part_rows", [sharding.PART_ROWS, 2])
def test_sharding(odd, real, monkeypatch, part_rows):
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    for df in (odd, real):
        out = sharding.shard(df, [1.0] * 40, [1.0] * 41).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows(df))
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
            assert r.shard == rendezvous_brute(r.doc_id, 40) and r.grown_shard == rendezvous_brute(r.doc_id, 41) and r.grown_shard in (r.shard, 40)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in sharding.shard(df, [1.0, 2.0, 1.0]).collect())
    assert abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02


# ---- 9


@pytest.mark.parametrize("table", ["odd", "real"])
def test_packing(request, table):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    df = request.getfixturevalue(table)
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in rows(df):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, p, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    out = packing.pack_documents(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    full = defaultdict(list)
    for r in out:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(full) <= sum(r.length for r in out) / 1024 * 1.1 + 3


def test_packing_of_many_histograms():
    rng = np.random.default_rng(9)
    for n, low, high in ((0, 1, 2), (1, 5, 6), (3000, 1, 1025), (500, 300, 700), (2000, 1, 40), (50, 1024, 1025), (400, 600, 601)):
        lengths = Counter(rng.integers(low, high, n).tolist())
        runs, bins = packing.pack(dict(lengths))
        used, numbers = defaultdict(list), defaultdict(list)
        for length, first, count, each, at, offset in runs:
            for i in range(count * each):
                numbers[length].append(first + i)
                used[at + i // each].append((offset + i % each * length, length))
        assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(c)) for k, c in lengths.items()}
        assert len(used) <= bins
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024


def best_fit_decreasing(lengths):
    gaps, bins = Counter(), 0
    for n in sorted(lengths, reverse=True):
        gap = next((g for g in range(n, 1025) if gaps[g]), None)
        if gap is None:
            bins, gap = bins + 1, 1024
        else:
            gaps[gap] -= 1
        gaps[gap - n] += 1
    return bins


@pytest.mark.parametrize("low, high, n", [(129, 1023, 3000), (1, 1024, 3000), (343, 699, 2000), (200, 400, 3000), (300, 360, 1000), (1, 128, 500)])
def test_packing_is_not_worse_than_best_fit(low, high, n):
    lengths = np.random.default_rng(low).integers(low, high + 1, n).tolist()
    bins = packing.pack(dict(Counter(lengths)))[1]
    assert -(-sum(lengths) // 1024) <= bins <= best_fit_decreasing(lengths)


def test_both_tokenizers_agree():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder()
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(10)
    texts = [" ".join(chars[i : i + 64]) for i in range(0, len(chars), 64)] + ["".join(rng.choice(list(" \n\t\r\x1c\x85\xa0'abzÉß1²½.,stT\x00"), 60)) for _ in range(300)]
    assert all(ids(x.encode()) == t.encode(x, add_special_tokens=False).ids for x in texts)


# ---- 10

URLS = [None, "", "no scheme", "http://", "https://A.Example.NET/en/1", "http://example.net/EN/1", "http://net", "http://x.net/", "ftp://planet/x", "http://b.example.com/de/x?y#z", "http://example.com/de", "http://w.org/fr/#top", "http://org?x=/fr/", "http://cheap-pills.example.com/en/1", "https://www.therer.example.com/en/814", "http://user@h.org:80/fr/é/東", "x" * 5000]


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_filters(spark):
    df = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string"))
    got = {r.page_id: r for r in url_filters.filter_urls(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = url_brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].probability >= url_filters.THRESHOLD else "allow"))
    assert url_filters.filter_urls(df.where("false")).count() == 0


def url_probability(host, path, w):
    g = url_filters.grams_of(host, path)
    return 1 / (1 + math.exp(-w[-1] - sum(w[i] for i in g) / math.sqrt(max(1, len(g)))))


def test_url_probabilities(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for r in url_filters.filter_urls(df).collect():
        assert r.probability == pytest.approx(url_probability(*url_brute(URLS[r.page_id])[:2], url_filters.weights()), abs=1e-6)


def test_url_model_holds_out():
    """Five folds: of rows that were not trained on, most unwanted and almost no ordinary ones are blocked."""
    rows_ = url_filters.labelled()
    fold = np.random.default_rng(0).integers(5, size=len(rows_))
    hit = Counter()
    for f in range(5):
        w = url_filters.train([r for r, k in zip(rows_, fold, strict=True) if k != f])
        for (host, path, label), k in zip(rows_, fold, strict=True):
            if k == f:
                hit[label, url_probability(host, path, w) >= url_filters.THRESHOLD] += 1
    assert hit[1, True] / (hit[1, True] + hit[1, False]) > 0.95 and hit[0, True] / (hit[0, True] + hit[0, False]) < 0.02


def test_url_training_rows_are_none_of_the_tables(spark):
    hosts = {r.h for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(url_filters.split_url(F.col("url"))[0].alias("h")).collect()}
    assert not hosts & {h for h, _, _ in url_filters.labelled()}


def test_url_of_great_length(spark):
    """Linear in the length: one url of 300,000 characters."""
    df = spark.createDataFrame([(1, "http://a.org/" + "xyz/é東" * 50000)], "page_id long, url string")
    assert url_filters.filter_urls(df).first().verdict in ("allow", "block")


# ---- pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, odd, number):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    _, stage = corpus_pipeline.STAGES[number]
    results = []
    for df in (odd, odd.where("false"), clashing(odd), clashing(odd, True)):
        out = stage(spark, df, SF)
        assert number == 4 or out.columns == df.columns
        results.append(Counter((r[0], r[1]) for r in out.collect()))
    assert not results[1] and results[0] == results[2] == results[3]


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(__import__("vecspark.llm.queries", fromlist=["x"]).oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    import oracle
    from vecspark.llm import queries

    assert oracle.differences(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name]) == []
