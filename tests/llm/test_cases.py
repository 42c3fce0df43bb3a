"""Cases that all operators share or that need their own small tables: hot keys, ties, repeats, scripts, odd columns."""

import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opslake.llm.common import Words
from opslake.llm import common, decontamination, language_id, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


# helpers -----------------------------------------------------------------------------------------------------------


def test_hot_keys_are_joined_like_others(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", "c", None, ""])) for i in range(3000)]
    counts = Counter(k for _, k in rows if k is not None)
    frame = spark.createDataFrame(rows, "i long, k string")
    table = spark.createDataFrame([(k, n, k.upper()) for k, n in counts.items() if k != "c"], "k string, n long, v string")
    got = {r.i: r.v for r in common.join_keyed(frame, table, "k", "n").collect()}
    assert got == {i: None if k in (None, "c") else k.upper() for i, k in rows}


def test_kinds_are_ranked_and_dealt_out_whole(spark):
    kinds = spark.createDataFrame([("a", 1, 9000), ("a", 2, 1), ("a", 3, 5), ("b", 4, 4096), ("b", 5, 4097)], "key string, id int, n long")
    ranked = common.ranked_kinds(kinds, "key", ["id"], "n", 8)
    got = defaultdict(list)
    for r in common.expanded(ranked, "n", ["id"]).collect():
        got[r.key].append((r["rank"], r.id))
    assert sorted(k for k, _ in got["a"]) == list(range(9006)) and sorted(k for k, _ in got["b"]) == list(range(8193))
    assert Counter(i for _, i in got["a"]) == {1: 9000, 2: 1, 3: 5}


def test_samples_are_bounded_whole_and_the_same_for_any_dealing(spark):
    rows = [(i % 700, f"text {i} " * (1 + i % 5), i % 3) for i in range(2100)] + [(1, "same", 0)] * 500
    frame = spark.createDataFrame(rows, "_id long, _text string, _group long")
    draws = [sorted(common.sample_texts(common.thinned(frame.repartition(n), F.xxhash64("_id", "_text"), 50), 50, 2000)) for n in (1, 7)]
    assert draws[0] == draws[1] and sum(len(t) for _, t, _ in draws[0]) <= 2000
    assert all((i, t, g) in set(rows) for i, t, g in draws[0])
    assert max(Counter(g for *_, g in common.sample_texts(frame, 50, 1 << 20)).values()) == 50


# op3 ---------------------------------------------------------------------------------------------------------------


def walk(ids, shards, vnodes, points, place_of, order):
    """Consistent hashing with bounded loads, written as rounds over single rows."""
    bound = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    places = [p for p, _ in points]
    arc = {i: next((k for k, p in enumerate(places) if p >= place_of[i]), 0) for i in set(ids)}
    waiting = sorted(((arc[i], order[i], i) for i in ids), key=lambda x: x[:2])
    at = [(a, a, k, i) for k, (a, _, i) in enumerate(waiting)]  # now at this point, arc, rank over all, row
    used, out = [0] * shards, defaultdict(list)
    while at:
        came = defaultdict(list)
        for point, a, k, i in sorted(at):
            came[points[point][1]].append((point, a, k, i))
        over = []
        for s, rows in came.items():
            room = bound[s] - used[s]
            out[s] += [i for *_, i in rows[:room]]
            over += rows[room:]
        for s, rows in came.items():
            used[s] = min(bound[s], used[s] + len(rows))
        at = []
        for point, a, k, i in over:
            nxt = next(p % len(points) for p in range(point + 1, point + 1 + len(points)) if used[points[p % len(points)][1]] < bound[points[p % len(points)][1]])
            at.append((nxt, a, k, i))
    return {s: Counter(v) for s, v in out.items()}


def test_overflow_follows_the_ring_and_any_dealing_gives_the_same(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(400), "x" * rng.randrange(9)) for _ in range(600)] + [(7, "same")] * 250 + [(None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [Counter(map(tuple, sharding.shard(spark, frame.repartition(n), 5, 6).collect())) for n in (1, 6)]
    assert got[0] == got[1]
    kinds = frame.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"))
    kinds = kinds.select("*", F.pmod(F.xxhash64(F.lit("row"), "doc_id"), F.lit(sharding.PLACES)).alias("place"), F.xxhash64("doc_id", "size", "crc").alias("mixed"))
    kinds = kinds.withColumn("salt", F.pmod(F.xxhash64("mixed", "doc_id", "size", "crc"), F.lit(8))).collect()
    points = [(r.place, r.shard) for r in sharding.ring(spark, 5, 6).orderBy("point").collect()]
    key = lambda r: (r.doc_id, r.size, r.crc)
    place_of, order = {key(r): r.place for r in kinds}, {key(r): (r.salt, r.mixed) for r in kinds}
    true = walk([key(r) for r in kinds], 5, 6, points, place_of, order)
    mine = defaultdict(Counter)
    for (doc_id, size, crc, _, shard, _, _), n in got[0].items():
        mine[shard][doc_id, size, crc] += n
    assert dict(mine) == true


# op2 ---------------------------------------------------------------------------------------------------------------


def test_groups_over_the_limit_lose_no_link(spark):
    """Fingerprints that agree in a half of their bits: one hot group in one partition of bits."""
    rng = random.Random(2)
    base, fps = 0xABCD1234, set()
    for _ in range(60):
        centre = rng.getrandbits(32)
        fps |= {((centre ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(3)))) << 32) | base for _ in range(5)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(frame, 3, group_limit=6).collect()}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in found:
        assert (u ^ v).bit_count() <= 3
        parent[root(u)] = root(v)
    for i, a in enumerate(fps):
        for b in fps[i:]:
            if (a ^ b).bit_count() <= 3:
                assert root(a) == root(b)


# op4 ---------------------------------------------------------------------------------------------------------------


def test_few_words_are_enough_and_number_signs_are_no_letters(spark):
    rows = [(1, "der die das und", "de", None, 1), (3, "the and of that", "en", None, 1), (4, "²", None, None, 1), (5, "½ ①", None, None, 1), (5, "½ ①", None, None, 1), (6, "слово", None, None, 1), (7, "the of " * 30_000, None, None, 1)]
    frame = spark.createDataFrame([(*r, "en", 3) for r in rows], DOC + ", lang_pred string, score int")
    got = defaultdict(list)
    for r in language_id.identify(spark, frame).collect():
        got[r.doc_id].append(r.lang_pred)
    assert got[1] == ["de"] and got[3] == ["en"] and got[4] == ["und"] and got[5] == ["und", "und"] and got[6][0] in ("de", "en") and got[7] == ["en"]


def test_more_languages_than_any_list_and_long_training_texts(spark):
    rng = random.Random(1)
    rows = []
    for k in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(k * 10 + j, " ".join(rng.choice(own) for _ in range(40 if j else 700)), f"l{k}", None, 1) for j in range(6)]
    frame = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark, frame).collect()}
    assert sum(got[i] == lang for i, _, lang, *_ in rows) >= 0.97 * len(rows)


# op5 ---------------------------------------------------------------------------------------------------------------


def test_short_items_are_found_as_whole_words_and_drop_nothing(spark):
    docs = spark.createDataFrame([(1, "say Aye  aye, captain", "x"), (2, "layers", "x"), (3, None, "x"), (1, "say Aye  aye, captain", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(5, "aye aye", 1), (6, "aye", 1), (7, "", 1), (8, None, 1)], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontamination.matches(spark, docs, items).collect())
    assert got == {(1, 5, 0): 2, (1, 6, 0): 2}
    assert decontamination.clean(spark, docs, items).count() == 4


def test_a_long_repetitive_text_stays_in_memory(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BANDS_AT_ONCE", 3)
    table = decontamination.Patterns([(1, "ab" * 60)])
    c = decontamination.codes("ab" * 3000)
    p, bands = table.candidates(c)
    edits, _ = table.align(c, 0, len(c), int(p[0]), bands[p == p[0]])
    assert len(edits) == (p == p[0]).sum() > 100 and edits.min() == 0


# op6 ---------------------------------------------------------------------------------------------------------------


def test_null_and_empty_hosts_are_one(spark):
    rows = [(i, "word " * 10, None, None if i % 2 else "", 1) for i in range(10)] + [(20 + i, " ".join(f"w{i}x{j}" for j in range(80)), None, "good", 1) for i in range(10)]
    got = quality_rules.judge(spark, spark.createDataFrame(rows, DOC)).collect()
    assert len({r.host_rate for r in got if r.doc_id < 10}) == 1 and all(r.kept for r in got if r.doc_id >= 20)


# op8 ---------------------------------------------------------------------------------------------------------------


def test_ties_hot_payloads_and_standard_fields(spark):
    hot = "<html>" + "h" * 2000
    rows = [(i, f"http://a b/{i}?q=%20é", hot) for i in range(200)] + [(199, "http://x", hot), (500, None, "ü" * 499), (501, None, "ü" * 499), (502, "u", "ü" * 500), (503, "u", "ü" * 500)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n string")
    archives = warc.write_archives(spark, pages, date="2024-05-06T07:08:09Z")
    got = warc.read_archives(spark, archives).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 500:
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 199 else ("revisit", 199)) and r.payload_bytes == 2006
        else:
            assert (r.record_type, r.refers_to) == (("revisit", 503) if r.page_id == 502 else ("response", None))
    assert {r.url for r in got if r.page_id == 3} == {"http://a%20b/3?q=%20%C3%A9"}
    raw = warc.record(3, "u", b"", 2006, "d1", 199, "2024-05-06T07:08:09Z").decode()
    assert f"WARC-Refers-To: {warc.record_id(199, 'd1')}" in raw and "WARC-Date: 2024-05-06T07:08:09Z" in raw and "HTTP/1.1 200 OK" in raw


# op9 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("before", "after", "quoted"),
    [
        ('he said "', '" and left', True),
        ("I don't like you ", " that's it", False),
        ("'", "'", True),
        ('"a" ', ' "b"', False),
        ("it's ", '"', False),
        ('"you ', '!" she', True),
        ("the dogs' ", " 'n' roll", False),
    ],
)
def test_quotation_needs_a_pair(before, after, quoted):
    assert toxicity.is_quoted(before, after) is quoted


def test_terms_of_any_script_match_themselves_and_marks_are_no_letters():
    terms = ["नालायकगधेड़ाबेवकूफ", "дурак", "bad", "idiot"]
    model = toxicity.ToxicityModel(terms)
    texts = ["x नालायकगधेड़ाबेवकूफ y", "ДУРАК!", "bad", "bed", "“idiot”", "«idot»", "idi0t", "a" * 100 + "idiot", None, "", "idioto idiot", "—idiot—", "idiot$$$ @@idiot", "id$ot"]
    _, index, edits, quoted, _ = model.hits(pa.array(texts))
    words = toxicity.Words(pa.array([toxicity.plain_marks((t or "").lower()) for t in texts]))
    got = Counter(words.doc[index].tolist())
    assert got == {0: 1, 1: 1, 2: 1, 4: 1, 5: 1, 6: 1, 10: 2, 11: 1, 12: 2, 13: 1}
    assert dict(zip(words.doc[index].tolist(), quoted.tolist()))[4] and edits.max() == 1


def test_mentions_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "Cd!", "é", "zz", "q9", "x" * 70]) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(3, None)]
    labels = [(i, 1, rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 1)]
    true = defaultdict(lambda: (set(), set()))
    for doc_id, text in rows:
        for y in {t for i, _, t in labels if i == doc_id and t is not None and zlib.crc32(str(i).encode()) % 5}:
            words = (text or "").lower().replace("!", " ").split()
            for before, w in zip(["", *words], words):
                if 2 <= len(w) <= 64:
                    true[w][y].add(before)
    got = {r.w: (r.n, r.k) for r in toxicity.mentions(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABEL)).collect()}
    assert got.keys() == true.keys()
    for w, (clean, marked) in true.items():
        assert got[w] == (len(clean) + len(marked), len(marked))


# all ---------------------------------------------------------------------------------------------------------------


def test_classifiers_take_clashing_columns_repeats_and_long_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(("fine" if i % 2 else "AWFUL!!") + str(rng.randrange(50)) for _ in range(40)), 1, 0.5, "x", 2) for i in range(200)]
    rows += [rows[4], rows[4], (900, "fine1 " * 200_000, 1, 0.5, "x", 2), (901, None, 1, 0.5, "x", 2), (None, "", None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, score double, predicted string, toxic int")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "t") for i in range(200)], LABEL + ", text string")
    for got in (quality_classifier.classify(spark, frame, labels), toxicity.detect(spark, frame, labels)):
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        found = got.collect()
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
        assert len({r.score for r in found if r.doc_id == 4}) == 1 and all(0 <= r.score <= 1 for r in found)
    kept = quality_classifier.keep_good(spark, frame, labels)
    assert kept.columns == frame.columns and 100 <= kept.count() <= 110


def test_filters_and_pipeline_of_empty_tables(spark, tmp_path):
    empty, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality_classifier.keep_good(spark, empty, labels).count() == 0
    assert decontamination.clean(spark, empty, items).count() == 0
    assert substring_dedup.strip_repeats(spark, empty).count() == 0
    assert simhash.keep_one(spark, empty).count() == 0
    for name, table in (("documents", empty), ("labels", labels), ("benchmark", items)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_substring_partitions_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 1000)
    frame = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)] + [(90, " ".join(f"w3x{j}" for j in range(60)))], "doc_id long, text string")
    assert substring_dedup.partitions_for(frame) > 15
    got = {r.doc_id: r.n_removed for r in substring_dedup.digest(spark, frame).collect()}
    assert {i for i, n in got.items() if n} == {3, 90} and got[3] == 60


def test_shared_folder_is_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_hashes_of_ranges_do_not_depend_on_the_place():
    values = np.arange(50, dtype=np.uint64)
    h = common.range_hashes(np.concatenate([values, values]), np.array([3, 53]), np.array([20, 70]), 12345)
    assert h[0] == h[1]


def test_tables_are_released_but_for_those_kept(spark):
    mark = common.tables_made()
    a, b = (common.written(spark.range(3)) for _ in range(2))
    common.release(spark, mark, b)
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        a.count()


def test_hashes_of_ranges_are_xxh64():
    import xxhash

    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    ranges = [(a, a + n) for n in range(80) for a in (rng.randrange(2900), 2999 - n + 1, 0)]
    start, end = (np.array(x) for x in zip(*ranges))
    assert simhash.hash_ranges(raw, start, end).tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in ranges]
    assert simhash.hash_ranges(b"", np.array([0]), np.array([0])).tolist() == [xxhash.xxh64_intdigest(b"", 42)]


def test_bits_are_summed_over_any_number_of_hashes():
    rng = np.random.default_rng(2)
    counts = np.array([1, 254, 255, 256, 3, 2000])
    h = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    h[:600] |= np.uint64(0xFF00FF)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    true = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0)
    assert (simhash.bit_sums(h, counts) == true).all()


@pytest.mark.parametrize("k", [1, 3, 16, 17, 40])
def test_posteriors_by_product_and_by_vector(k, monkeypatch):
    rng = np.random.default_rng(k)
    emit, move = rng.normal(0, 2, (700, k)).astype(np.float32), rng.normal(0, 1, (k, k))
    first = np.array([0, 0, 5, 37, 38, 70, 200, 264, 700])
    found = []
    for limit in (0, 1000):
        monkeypatch.setattr(language_id, "PRODUCT_LANGS", limit)
        found.append(language_id.posteriors(emit, first, move))
    assert np.abs(found[0] - found[1]).max() < 1e-5


def test_two_hundred_languages_on_a_full_piece():
    """Memory follows neither the square of the languages nor the length of a text."""
    rng, pick = np.random.default_rng(2), random.Random(2)
    k = language_id.MAX_LANGS
    model = language_id.CrfModel([f"l{i}" for i in range(k)], rng.normal(0, 0.3, (language_id.SLOTS, k)), rng.normal(0, 0.5, (k, k)))
    assert model.weights.dtype == np.float32
    text = " ".join("".join(pick.choices("abcdefghijklmnop", k=pick.randrange(2, 9))) for _ in range(60_000))[: model.piece_bytes + 50_000]
    tracemalloc.start()
    model.predict(pa.array([text[i : i + 900] for i in range(0, model.piece_bytes, 900)]))
    lang, score = model.predict(pa.array([text]))  # longer than a piece
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    words = Words(language_id.folded(pa.array([text])))
    mean = language_id.posteriors(language_id.emissions(words, model.weights), words.first, model.move).mean(axis=0)
    assert lang == [model.labels[mean.argmax()]] and abs(score[0] - mean.max()) < 1e-5


def test_gradient_of_the_sequences():
    """Against finite differences of the log-likelihood, which is summed over all labellings."""
    rng = np.random.default_rng(6)
    emit, move, label = rng.normal(0, 1, (2, 4, 3)), rng.normal(0, 1, (3, 3)), rng.integers(0, 3, (2, 4))

    def likelihood(emit, move):
        total = 0.0
        for e, y in zip(emit, label):
            value = lambda p: sum(e[t, c] for t, c in enumerate(p)) + sum(move[i, j] for i, j in zip(p, p[1:]))  # noqa: E731, B023
            total += value(y) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=4)))
        return total

    by_word, by_move = language_id.gradient(emit, label, move)
    for array, found in ((emit, by_word), (move, by_move)):
        for at in np.ndindex(array.shape):
            step = np.zeros_like(array)
            step[at] = 1e-5
            up, down = (likelihood(emit + s * step, move) if array is emit else likelihood(emit, move + s * step) for s in (1, -1))
            assert abs((up - down) / 2e-5 - found[at]) < 1e-6


def test_frequent_terms_are_learned(spark):
    """Contexts are counted however many they are: 20,000 toxic and 400 clean ones, and a word of both kinds alike."""
    ids = [i for i in range(60_000) if zlib.crc32(str(i).encode()) % 5 != 0][:22_000]
    rows, labels = [], []
    for n, i in enumerate(ids):
        toxic = int(n < 20_000)
        word = "villain" if toxic or n < 20_400 else "flower"
        rows.append((i, f"c{n} {word} and c{n} table", "en", None, 0))
        labels.append((i, 1, toxic))
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)
    for limit in (toxicity.BROADCAST_LABELS, 10):
        counts = {r["w"]: (r["n"], r["k"]) for r in toxicity.mentions(docs, marks, limit).where("w in ('villain', 'flower', 'table')").collect()}
        assert counts == {"villain": (20_400, 20_000), "flower": (1600, 0), "table": (22_000, 20_000)}
    assert "villain" in toxicity.learn_terms(docs, marks)


def test_repetitive_texts_are_cut_by_their_size(spark):
    """Texts that compress a hundredfold: pieces follow the size of the text, not of what travels."""
    line = "all rights reserved by nobody in particular and the same line again\n"
    rows = [(i, line * 2000 + f"own{i}", "en", None, 0) for i in range(60)]
    frame = spark.createDataFrame(rows, DOC).repartition(2)
    packed = substring_dedup._joined(frame.select("doc_id", "text"), frame.select(F.col("doc_id").alias("d"), F.xxhash64("doc_id", "text").alias("_k")), "inner", ["_k"])
    batches = packed.select("_z", "_size").toArrow().to_batches()
    assert sum(z.nbytes for b in batches for z in [b.column("_z")]) < sum(len(r[1]) for r in rows) / 50
    assert all(sum(b.column("_size").to_pylist()) <= common.PIECE_BYTES or b.num_rows == 1 for b in common.pieces(batches, "_size"))
    kept = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(frame).collect()}
    assert kept == {i: (2000 * 12 + 1, 2000 * 12, f"own{i}") for i in range(60)}


def test_rows_with_one_key_keep_their_own_verdicts(spark, monkeypatch):
    """Rows whose 64-bit keys are equal, one much longer than the other: candidates mix, verdicts do not."""
    monkeypatch.setattr(substring_dedup, "_keyed", lambda docs: docs.withColumns({"_k": F.lit(5).cast("long"), "_c": F.hash("doc_id", "text")}))
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, "a b c", "en", None, 0), (2, shared + " " + " ".join(f"x{rng.random()}" for _ in range(400)), "en", None, 0), (3, "y " * 3 + shared, "en", None, 0), (4, " ".join(f"z{i}" for i in range(60)), "en", None, 0)]
    kept = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOC)).collect()}
    assert kept == {1: 0, 2: 50, 3: 50, 4: 0}
    assert substring_dedup.uncovered(3, np.array([0, 90]), 35).tolist() == [True] * 3


def test_quality_scores_equal_plain_compression(spark):
    """Dictionaries are the labelled texts outside the held-out fold, sizes those of zstandard with them, one text at a time,
    and a score is the curve of the size difference."""
    import math

    import zstandard

    rng = random.Random(12)
    word = {1: [f"good{i}" for i in range(40)], 0: [f"BAD!{i}" for i in range(40)]}
    rows = [(i, " ".join(rng.choice(word[i % 2]) if rng.random() < 0.8 else rng.choice(word[1 - i % 2]) for _ in range(rng.randrange(3, 60))), "en", None, 0) for i in range(160)]
    rows += [(500, None, "en", None, 0), (501, "", "en", None, 0), (502, "née " * 30, "en", None, 0)]
    labels = [(i, i % 2, 0) for i in range(0, 160, 2)] + [(i, i % 2, 0) for i in range(1, 100, 2)]
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)
    model = quality_classifier.fit(docs, marks)
    kept = {y: sorted(t for i, t, *_ in rows for j, q, _ in labels if i == j and q == y and zlib.crc32(str(i).encode()) % 5) for y in (0, 1)}
    assert sorted(model.good.decode().splitlines()) == kept[1] and sorted(model.bad.decode().splitlines()) == kept[0]

    def size(raw, content):
        plain = zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        return len(plain.compress(raw))

    scores = {r.doc_id: r.score for r in quality_classifier.score(spark, docs, model).collect()}
    for i, text, *_ in rows:
        raw, x = (text or "").encode(), [0.0] * 4
        if raw:
            g, b = size(raw, model.good), size(raw, model.bad)
            x = [(b - g) / len(raw), (b - g) / min(b, g), math.log(min(b, g) / len(raw)), math.log(len(raw))]
        z = sum(a * w for a, w in zip([*x, 1.0], model.weights))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
    assert sum(scores[i] for i in range(1, 160, 2)) > 4 * sum(scores[i] for i in range(0, 160, 2))
