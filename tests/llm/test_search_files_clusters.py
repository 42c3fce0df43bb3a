"""Ranked search, token files and clustering against brute force, and their cases."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from opslake.llm import centroids, ranked_search, token_files

DOC = "doc_id long, text string, rank int, score string"  # names that also occur in results
ITEM = "item_id long, text string, doc_id int"


def terms_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def best_by_hand(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t, *_ in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text, *_ in items:
        scored = []
        for i, bag in bags:
            score = 0
            for t, times in Counter(terms_of(text)).items():
                if bag[t]:
                    m = 25 + 75 * sum(bag.values()) * n // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=str)


def found_by(spark, docs, items, **how):
    out = ranked_search.search(spark, spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["Ünï", "Straße", "x_y", "a\tb", "漢字"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randrange(1, 60))), i, "s") for i in range(300)]
    docs += [(i, docs[7][1], 0, None) for i in range(400, 430)]  # thirty ties
    docs += [docs[11], docs[11], (None, docs[7][1], 0, None), (None, None, None, None), (900, "", 0, ""), (901, " .,!\x00\x7f", 0, "")]
    docs += [(902, " ".join(rng.choices(words, k=30_000)), 0, "")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40))), 0) for i in range(25)]
    items += [(50, docs[7][1], 0), (51, None, 0), (52, "", 0), (53, "nowhere at all", 0), items[3], items[3], (None, "w1 W2 w2 w2", 1)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"postings": 150}, {"block_chars": 700}, {"k": 3, "postings": 1}])
def test_best_positions_find_the_best(spark, library, how):
    docs, items = library
    assert found_by(spark, docs, items, **how) == best_by_hand(docs, items, how.get("k", 10))


def test_search_of_empty_tables(spark, library):
    docs, items = library
    assert found_by(spark, [], items) == [] == found_by(spark, docs, [])
    assert found_by(spark, [(1, None, 0, "")], items) == []


def test_equal_scores_go_by_id(spark):
    docs = [(i, "same words here", 0, "") for i in random.Random(1).sample(range(1000), 60)] + [(5000, "other", 0, "")]
    rows = found_by(spark, docs, [(1, "words", 0)], postings=20)
    assert sorted(i for _, _, i, _ in rows) == sorted(d[0] for d in docs)[:10]


def test_reading_stops_early_and_not_too_early():
    """A segment in which few documents hold all terms: most positions are never seen, and the result is exact."""
    rng = np.random.default_rng(4)
    n = 20_000
    g = [np.sort(rng.pareto(1.0, n) * 1000).astype(np.int64) + 1 for _ in range(3)]
    doc, term = np.tile(np.arange(n), 3), np.repeat(np.arange(3), n)
    g[0][:], g[1][:] = rng.permutation(g[0]), rng.permutation(g[1])
    g[2][:] = g[0] // 2 + 1
    segment = ranked_search.Segment(np.arange(n), np.zeros(n, bool), doc, term, np.concatenate(g))
    here, score = segment.search([(0, 3), (1, 1), (2, 2)], 10, 0)
    whole = 3 * g[0] + g[1] + 2 * g[2]
    want = np.lexsort((np.arange(n), -whole))[:10]
    assert here.tolist() == want.tolist() and score.tolist() == whole[want].tolist()
    assert segment.accesses < 3 * n / 5
    before = segment.accesses
    assert len(segment.search([(0, 3), (1, 1), (2, 2)], 10, int(whole.max()) + 1)[0]) == 0  # better ones are known from elsewhere
    assert segment.accesses - before < 3 * n / 5


def test_terms_are_found_by_their_bytes():
    vocabulary = ranked_search.Vocabulary([b"one", b"two", "é".encode()])
    words = ranked_search.Terms(pa.array(["One,two", None, "é", "", "thr two", "ONE"]))
    word, number = vocabulary.find(words)
    assert [(words.doc[w].item(), vocabulary.terms[n]) for w, n in zip(word, number)] == [(0, b"one"), (0, b"two"), (2, "é".encode()), (4, b"two"), (5, b"one")]
    vocabulary.bytes = vocabulary.bytes.copy()
    vocabulary.bytes[vocabulary.at[vocabulary.number[b"two"]]] = ord("x")  # as if another word had the hash of "two"
    assert len(vocabulary.find(words)[0]) == 3


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path(token_files.TOKENIZER))
    t.encode_special_tokens = True
    return t


DOCS = "doc_id long, text string, lang string, part int, ids string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    bits = ["a", "Word", "don't", "'s", " ", "  ", "\n", "\t", " ", "　", " ", "é", "漢", "12", "_", ".,", "<|endoftext|>", "\x00", "\x7f", "😀", "ẞ"]
    rows = [(rng.randrange(10_000), "".join(rng.choices(bits, k=rng.randrange(0, 60))), rng.choice(["en", None]), 9, "x") for _ in range(400)]
    rows += [(77, "hot", "en", 1, "")] * 500 + [(None, "no id", None, None, None), (None, None, None, None, None), (12, None, "de", 0, ""), (13, " ".join(f"w{rng.randrange(9999)}" for _ in range(40_000)), "en", 0, "")]
    return rows


def plain_ids(tokenizer, rows):
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_hold_every_id(spark, tokenizer, texts, encoding):
    folder = token_files.write(spark, spark.createDataFrame(texts, DOCS).repartition(5), encoding=encoding, page_bytes=4096)
    want = sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in plain_ids(tokenizer, texts)), key=str)
    rows = [tuple(r) for r in token_files.digest(spark, folder).collect()]
    assert sorted(((i, n, c) for i, _, n, c in rows), key=str) == want
    at = 0
    for i, start, n, _ in sorted(rows, key=lambda r: r[1]):  # gapless, by rising id, null ids first
        assert start == at
        at += n
    ids = [i for i, *_ in sorted(rows, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(folder.removeprefix("file://") + "/data/*.parquet")]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    columns = {c.path_in_schema: c for g in groups for c in [g.column(i) for i in range(g.num_columns)]}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values() if c.path_in_schema != "meta.lang")
    assert ("RLE_DICTIONARY" in columns["ids.list.element"].encodings) == (encoding == "dictionary")
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and (encoding == "dictionary" or "DELTA_BINARY_PACKED" in columns["ids.list.element"].encodings)
    assert columns["meta.lang"].physical_type == "BYTE_ARRAY"  # a metadata column that is there; "source" is not


def test_parts_of_token_files(spark, tokenizer, texts):
    folder = token_files.write(spark, spark.createDataFrame(texts, DOCS))
    by_id = {i: ids for i, ids in plain_ids(tokenizer, texts) if i in (12, 13)}
    some = {r["doc_id"]: r["ids"] for r in token_files.documents_between(spark, folder, 12, 13).collect()}
    assert some == by_id
    plan = token_files.documents_between(spark, folder, 12, 13)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,12), LessThanOrEqual(doc_id,13)" in plan
    assert "ids" not in token_files.metadata(spark, folder).columns
    data = spark.read.parquet(f"{folder}/data")
    base = {r["part"]: r["base"] for r in spark.read.parquet(f"{folder}/manifest").collect()}
    whole = sorted((base[r["part"]] + r["place"], r["ids"]) for r in data.collect())
    flat = [t for _, ids in whole for t in ids]
    for start, stop in ((0, 1), (10, 5000), (len(flat) - 7, len(flat) + 100), (50, 50), (len(flat), len(flat) + 5)):
        rows = sorted((r["start"], r["ids"]) for r in token_files.tokens_between(spark, folder, start, stop).collect())
        assert [t for _, ids in rows for t in ids] == flat[start:stop]
    # another reader sees the same
    assert sorted(sum((pq.read_table(f)["n_tokens"].to_pylist() for f in glob.glob(folder.removeprefix("file://") + "/data/*.parquet")), [])) == sorted(len(ids) for _, ids in whole)


def test_token_files_of_an_empty_table(spark):
    folder = token_files.write(spark, spark.createDataFrame([], DOCS))
    assert token_files.digest(spark, folder).collect() == [] == token_files.tokens_between(spark, folder, 0, 10).collect()
    with pytest.raises(ValueError):
        token_files.write(spark, spark.createDataFrame([], DOCS), encoding="plain")


VECTOR = "vec_id long, embedding array<float>, cluster string, vec int"


def clusters_by_hand(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in v)]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in hashed[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, m), j) for j, m in enumerate(c))[::-1] for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (a, _) in zip(kept, own) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, a, d) for (i, _), (a, d) in zip(kept, assign())), key=str), c


def vectors(n, dims, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, dims))
    return [(i, (middle[i % groups] + rng.normal(0, spread, dims)).astype(np.float32).tolist(), "c", 0) for i in range(n)]


@pytest.mark.parametrize(("k", "dims", "spread"), [(8, 6, 0.05), (8, 6, 2.0), (3, 4, 1.0), (1, 4, 1.0)])
def test_clusters_equal_brute_force(spark, k, dims, spread):
    rows = vectors(250, dims, 5, spread)
    rows += [rows[3], rows[3], (None, rows[5][1], None, None), (None, [0.0] * dims, "", 1)] + [(900 + i, [0.5] * dims, "", 0) for i in range(80)]  # repeats and ties
    odd = [None, [], [1.0] * (dims + 1), [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [70000.0] * dims]
    rows += [(500 + i, v, "", 0) for i, v in enumerate(odd)]
    members, middles, _ = centroids.cluster(spark.createDataFrame(rows, VECTOR).repartition(3), k=k, rounds=6, dims=dims)
    want, c = clusters_by_hand(rows, k, 6, dims)
    assert middles.tolist() == c
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in members.collect()), key=str) == want


def test_only_expired_vectors_are_compared_again(spark):
    rows = vectors(600, 5, 8, 0.02, seed=3)
    _, _, rescanned = centroids.cluster(spark.createDataFrame(rows, VECTOR), k=8, rounds=10, dims=5)
    assert sum(rescanned) < 0.7 * 600 * len(rescanned)


def test_runs_are_merged(spark):
    """Gaps near zero pop all vectors in each round: runs stay few, and the result stays exact."""
    rows = vectors(120, 6, 1, 3.0, seed=5)
    table = spark.createDataFrame(rows, VECTOR)
    x = centroids.integer_vectors(table, 6)
    heaps = centroids.Heaps(x, centroids.seeds(x, 5))
    for _ in range(9):
        if not heaps.move():
            break
        heaps.reassign()
        assert sum(r.rows for r in heaps.runs) <= 4 * 120
        assert heaps.members().count() == 120
    want, c = clusters_by_hand(rows, 5, len(heaps.rescanned), 6)
    assert heaps.centroids.tolist() == c
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in heaps.members().collect()), key=str) == want


def test_few_or_no_vectors(spark):
    few = vectors(3, 64, 3, 0.1)
    members, middles, _ = centroids.cluster(spark.createDataFrame(few, VECTOR))
    assert len(middles) == 3 and sorted(r["cluster"] for r in members.collect()) == [0, 1, 2]
    out = centroids.clustered(spark, spark.createDataFrame([], VECTOR))
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    hashes = {r["cluster"]: r["centroid_sha256"] for r in centroids.clustered(spark, spark.createDataFrame(few, VECTOR)).collect()}
    assert hashes == {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(middles.tolist())}
