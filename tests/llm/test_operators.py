"""The ten operators against brute force on small tables, and their cases: nulls, empty tables, repeats, long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from opslake.llm import decontamination, language_id, packing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(5, 220)) for _ in range(120)]
    shared = prose(rng, 60)
    for i in range(0, 40, 2):
        texts[i] += "\n" + shared + " " + prose(rng, 10)
    for i in range(60, 75):
        texts[i] = texts[60]
    for i in range(80, 84):  # one word apart
        texts[i] = " ".join([*texts[80].split()[:-1], f"x{i}"])
    texts += [None, None, "", "  \n ", "one", "one two", "ALL caps Ünïcode", "line\nline\nline\n\nother", prose(rng, 21_000, 5000)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all", None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def small_pages(spark):
    body = "<html><body>" + "same page " * 200 + "</body></html>"
    rows = [(i, f"http://h{i % 3}.org/{i}", body if i % 3 == 0 else f"<p>{i}</p>" * (1 + i * 7)) for i in range(60)]
    rows += [(100, None, None), (101, "http://e.org", ""), (None, "http://n.org", body), (3, "http://h0.org/3", body)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, size int")


# op1 ---------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_gapless_and_true_to_the_tokenizer(spark, docs, corpus):
    from tokenizers import Tokenizer

    rows = packing.pack(spark, docs).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    expected = Counter()
    for doc_id, text, *_ in corpus:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_ids_are_the_tokenizers_on_any_text(spark):
    """Random texts with accents (composed and not), ligatures, scripts, symbols, contractions, odd blanks and marks."""
    from tokenizers import Tokenizer

    rng = random.Random(5)
    alphabet = list("abcdeABDéèüßöñÿŸªºµ×÷Þþ   \n\t'.,!?-_#@0189²½") + ["\u0301", "\u0308", "\u0327", "ﬁ", "İ", "ſ", "\u212a", "中", "ا", "\u200d", "😀", "\xa0", "\x0b", "<|endoftext|>", "'s", "'re", "É", "\u2028", "\x85", "Σ", "ǅ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["cafe\u0301 café", "e\u0301,", "I\u0307\u0327"]
    got = packing.encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    true = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in got} == true


@pytest.mark.parametrize("lengths", [[7] * 5000, [1], [4096] * 3, [2049] * 10, list(range(1, 400)) * 3, [4000, 97, 96, 95] * 50])
def test_sweeps_place_every_document_once(lengths):
    u, n = np.unique(lengths, return_counts=True)
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in packing.match_runs(u, n).tolist():
        for j in range(count):
            fill[first + j].append((offset, length))
            ranks[length].append(rank + j)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert all(sorted(ranks[length]) == list(range(count)) for length, count in zip(u.tolist(), n.tolist()))


def test_sweep_takes_the_successor_and_waits_by_rank():
    # documents 2, 2, 5 and gaps 1, 2, 3, 4: both twos take gaps 2 and 3, five waits
    doc, place, run, inside, size = packing.sweep(np.array([2, 5]), np.array([2, 1]), np.array([1, 2, 3, 4]), np.array([1, 1, 1, 1]))
    assert list(zip(doc, place, run, size)) == [(0, 0, 1, 1), (0, 1, 2, 1)]
    assert inside.tolist() == [0, 0]


# op2 ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(raw[i : i + 3]) for i in range(len(raw) - 2)] if len(raw) >= 3 else [b" ".join(raw)] if raw else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    parent = list(range(len(items)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(items):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return Counter((doc_id, f"{fp:016x}", least.get(find(i))) for i, (doc_id, fp) in enumerate(items))


def test_simhash_matches_brute_force(spark, docs, corpus):
    rows = simhash.near_duplicates(spark, docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == brute_components([(d, brute_fingerprint(t)) for d, t, *_ in corpus])


@pytest.mark.parametrize("group_limit", [8192, 20])
def test_links_span_the_true_components(spark, group_limit):
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(12)]
    prints = set(centers)
    for c in centers[:4]:
        for _ in range(150):
            x = c
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(nodes, 3, group_limit).collect()
    assert all(((e.u ^ e.v) & (1 << 64) - 1).bit_count() <= 3 for e in edges)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    got = Counter(found.get(p, p) for p in signed)
    assert sorted(got.values()) == sorted(Counter(c for *_, c in brute_components(list(zip(range(len(prints)), prints)))).values())


def test_allotment_is_cheapest():
    costs = [[0, 10, 50, 90, 99], [0, 1, 2, 60, 99], [0, 30, 80, 90, 99]]
    cost, ts = simhash.allot(costs, 1)
    assert sum(ts) == 1 and cost == min(costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1] for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if a + b + c == 1)


def test_keep_one_leaves_one_row_of_each_group(spark, docs, corpus):
    kept = simhash.keep_one(spark, docs).collect()
    groups = {c for _, _, c in brute_components([(d, brute_fingerprint(t)) for d, t, *_ in corpus])}
    assert len(kept) == len(groups) or len(kept) == len(groups) + 1  # a group without ids counts as one
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids))


# op3 ---------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(spark, docs, corpus):
    rows = sharding.shard(spark, docs, shards=7, vnodes=8).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and len(slots) == 7
    expected = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected


def test_rows_of_one_id_overflow(spark):
    rows = spark.createDataFrame([(1, "x")] * 90 + [(2, None)] * 5, "doc_id long, text string")
    assert sorted(Counter(r.shard for r in sharding.shard(spark, rows, shards=4, vnodes=4).collect()).values()) == [23, 24, 24, 24]


def test_most_rows_stay_at_their_ring_place(spark, docs):
    """Only overflow leaves its place: with room to spare nobody moves."""
    points = sharding.ring(spark, 5, 16)
    counts = spark.createDataFrame([(a, 1) for a in range(80)], "arc int, n long")
    placed = sharding.place_arcs(counts, points, 5, 5000).collect()
    owner = {r.point: r.shard for r in points.collect()}
    assert all(owner[r.arc] == r.shard for r in placed) and len(placed) == 80


# op4 ---------------------------------------------------------------------------------------------------------------


def two_languages(n=240):
    rng = random.Random(1)
    a, b = ["the", "thing", "shore", "would", "path"], ["der", "über", "schein", "nicht", "ung"]
    rows = []
    for i in range(n):
        vocabulary = a if i % 2 else b
        rows.append((i, " ".join(rng.choice(vocabulary) + rng.choice(["", "er", "s"]) for _ in range(rng.randrange(20, 90))), "aa" if i % 2 else "bb", "s", 1))
    return rows


def test_language_is_found_and_switches_are_labelled(spark):
    rows = two_languages()
    frame = spark.createDataFrame([*rows, (900, None, "aa", "s", 1), (901, "12 34 --", "bb", "s", 1), (902, "", None, None, None)], DOC)
    model = language_id.fit(frame)
    got = {r.doc_id: r for r in language_id.identify(spark, frame, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    labels = [lang for _, lang, _ in model.label_words("the thing would the shore the path nicht der schein über der nicht")]
    assert labels[:6] == ["aa"] * 6 and labels[-5:] == ["bb"] * 5


def test_forward_backward_in_blocks_is_exact():
    rng = np.random.default_rng(0)
    sizes = [1, 31, 32, 33, 200, 0, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit, move = rng.normal(0, 2, (first[-1], 3)), rng.normal(0, 1, (3, 3))
    got = language_id.posteriors(emit, first, move)
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        e, t = np.exp(emit[a:b]), np.exp(move)
        f, back = [np.ones(3) @ t * e[0]], [np.ones(3)]
        for i in range(1, b - a):
            f.append(f[-1] @ t * e[i])
        for i in range(b - a - 1, 0, -1):
            back.append(t @ (e[i] * back[-1]))
            back[-1] /= back[-1].sum()
        f = np.array([x / x.sum() for x in f])
        g = f * np.array(back[::-1])
        g /= g.sum(axis=1, keepdims=True)
        assert np.allclose(got[a:b], g, atol=1e-4)


def test_language_without_labels(spark, empty):
    frame = spark.createDataFrame([(1, "some text", None, None, 1)], DOC)
    assert language_id.identify(spark, frame).collect()[0].lang_pred == "und"
    assert language_id.identify(spark, empty).count() == 0


# op5 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(11)
    items = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(14, 60)))) for i in range(30)]
    return [*items, (30, None), (31, "short")]


def test_decontamination_finds_exact_and_edited_passages(spark, benchmark):
    rng = random.Random(2)
    rows, expected = [], set()
    for i in range(90):
        text = prose(rng, 150)
        if i % 3 == 0:
            item, passage = benchmark[i // 3]
            passage = list(passage.upper() if i % 2 else passage)
            for _ in range(int(len(passage) * 0.05) if i % 6 == 0 else 0):
                passage[rng.randrange(len(passage))] = "z"
            text = text[:200] + " " + "".join(passage).replace(" ", "\n ") + " " + text[200:]
            expected.add((i, item))
        rows.append((i, text))
    frame = spark.createDataFrame([*rows, (200, None), (201, "")], "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    for block in (1 << 20, 2000):
        found = decontamination.matches(spark, frame, items, block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
    kept = decontamination.clean(spark, frame, items)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] % 3} | {200, 201}


def test_filter_and_alignment_agree_with_full_dynamic_programming():
    rng = random.Random(4)
    pattern = "".join(rng.choice("abcd ") for _ in range(100)).strip()
    table = decontamination.Patterns([(0, pattern)])
    text = decontamination.fold(pattern)

    def best(hay, needle):
        row = [0] * (len(hay) + 1)
        for i, c in enumerate(needle, 1):
            last, row[0] = row[0], i
            for j, h in enumerate(hay, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (h != c))
        return min(row)

    for edits in range(0, 12):
        changed = list(text)
        for _ in range(edits):
            o, j = rng.randrange(3), rng.randrange(len(changed))
            if o == 0:
                changed[j] = "z"
            elif o == 1:
                del changed[j]
            else:
                changed.insert(j, "y")
        hay = "e" * 37 + "".join(changed) + "f" * 20
        c = decontamination.codes(hay + "\n")
        p, band = table.candidates(c)
        true = best(hay, text)
        got = table.align(c, 0, len(hay), 0, band)[0].min() if len(p) else 99
        if true <= table.budget[0]:
            assert got == true


# op6 ---------------------------------------------------------------------------------------------------------------


def test_rules_match_brute_force_and_only_bad_hosts_are_strict(spark, docs, corpus):
    rows = quality_rules.judge(spark, docs).collect()

    def measures(text):
        w, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((d, *measures(t)) for d, t, *_ in corpus)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert all(not r.kept for r in rows if r.base_failed) and all(r.kept for r in rows if not r.base_failed and not r.host_bad)


def test_a_bad_host_keeps_its_clean_documents(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, 80, 5000), "en", "good" if i < 50 else "bad", 1) for i in range(60)]
    noisy = [(100 + i, " ".join(w + "$$$" for w in prose(rng, 80, 5000).split()), "en", "good" if i < 2 else "bad", 1) for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.judge(spark, spark.createDataFrame(clean + noisy, DOC)).collect()}
    assert all(got[i].kept for i in range(60))
    assert got[100].kept and not got[110].kept and got[110].host_bad and not got[100].host_bad


# op7 ---------------------------------------------------------------------------------------------------------------


def brute_removal(corpus, width=35):
    seen = Counter()
    for _, text, *_ in corpus:
        w = words_of(text)
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for doc_id, text, *_ in corpus:
        w = words_of(text)
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((doc_id, w, [x for j, x in enumerate(w) if j not in gone]))
    return out


def test_substrings_match_brute_force(spark, docs, corpus):
    rows = substring_dedup.digest(spark, docs).collect()
    expected = Counter((d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, w, k in brute_removal(corpus))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == expected


@pytest.mark.parametrize("shift", range(0, 42, 5))
def test_windows_of_exactly_the_least_length_are_found_at_any_alignment(spark, shift):
    rng = random.Random(shift)
    passage = [f"p{i}" for i in range(35)]
    a = [f"a{rng.random()}" for _ in range(shift)] + passage + ["end"]
    b = [f"b{rng.random()}" for _ in range(17)] + passage + ["fin"]
    c = passage[:34] + ["other"]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((a, b, c))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame).collect()} == {0: 35, 1: 35, 2: 0}


def test_cover_has_every_difference():
    for window in (2, 3, 8, 12, 20, 35, 50):
        period, residues = substring_dedup.cover_of(window)
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
        assert window - period + 1 >= 1


def test_stripped_rows_keep_columns_and_untouched_text(spark, docs, corpus):
    rows = substring_dedup.strip_repeats(spark, docs).collect()
    expected = Counter()
    for (doc_id, text, lang, source, _), (_, w, kept) in zip(corpus, brute_removal(corpus)):
        if len(w) == len(kept):
            expected[doc_id, text, lang, source] += 1
        elif kept:
            expected[doc_id, " ".join(kept), lang, source] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in rows) == expected
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in rows)


# op8 ---------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, small_pages):
    pages = small_pages.collect()
    archives = warc.write_archives(spark, small_pages, archive_bytes=20_000)
    assert archives.count() > 2
    rows = warc.read_archives(spark, archives).collect()
    keeper = {}
    for p in pages:
        raw = (p.html or "").encode()
        if len(raw) >= 1000 and p.page_id is not None:
            keeper[raw] = max(keeper.get(raw, p.page_id), p.page_id)
    expected = Counter()
    for p in pages:
        raw = (p.html or "").encode()
        to = keeper.get(raw) if p.page_id is not None and keeper.get(raw) != p.page_id else None
        expected[p.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected
    assert {r.page_id: r.html for r in rows if r.record_type == "response" and r.page_id == 7}[7] == pages[7].html


def test_an_archive_begins_with_its_dictionary(spark, small_pages):
    path = warc.write_archives(spark, small_pages).first().path.removeprefix("file://")
    with open(path, "rb") as f:
        raw = f.read()
    assert raw[:4] == bytes.fromhex("5d2a4d18") and sum(1 for _ in warc.frames(raw)) > 0


def test_no_pages_no_archives(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(spark, none)).count() == 0


# op9 ---------------------------------------------------------------------------------------------------------------


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_accepts_exactly_the_misspellings():
    terms = ["idiot", "pathetic", "scum"]
    letters, table, accepts = toxicity.compile_automaton(terms)
    rng = random.Random(9)
    tried = set(terms)
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randrange(1, 4)):
                o, j = rng.randrange(4), rng.randrange(len(w))
                if o == 0:
                    w[j] = rng.choice("abcdiostx")
                elif o == 1 and len(w) > 1:
                    del w[j]
                elif o == 2:
                    w.insert(j, rng.choice("abcdiostx"))
                elif j + 1 < len(w):
                    w[j], w[j + 1] = w[j + 1], w[j]
            tried.add("".join(w))
    for w in tried:
        state = 1
        for c in w:
            state = table[state, letters.get(c, 0)]
        least = min((d for t in terms if (d := distance(w, t)) <= (2 if len(t) >= 8 else 1)), default=-1)
        assert accepts[state] == least, w


def test_toxic_texts_are_found_misspelt_and_quotation_counts_less(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, 40, 3000).split()
        if i % 3 == 0:
            w.insert(rng.randrange(40), rng.choice(["horrible", "dreadful"]))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(900, "w1 w2 horible w3", None, None, 1), (901, None, None, None, None), (902, "", None, None, None), (903, 'w5 he said "horrible" w6', None, None, 1), (904, "w5 he is horrible w6", None, None, 1)]
    frame = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in toxicity.detect(spark, frame, spark.createDataFrame(labels, LABEL)).collect()}
    assert sum(got[i].predicted == int(i % 3 == 0) for i in range(300)) >= 295
    assert got[900].predicted == 1 and got[901].predicted == got[902].predicted == 0
    assert got[903].score < got[904].score
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))


def test_scores_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], LABEL)
    assert {r.score for r in toxicity.detect(spark, docs, none).collect()} == {0.0}
    assert {r.score for r in quality_classifier.classify(spark, docs, none).collect()} == {0.5}
    assert toxicity.detect(spark, empty, none).count() == quality_classifier.classify(spark, empty, none).count() == 0


# op10 --------------------------------------------------------------------------------------------------------------


def test_quality_is_learned(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 != 0
        text = prose(rng, 60, 300) if good else " ".join(w.upper() + "!!" for w in prose(rng, 60, 300).split())
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    frame = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, None)], DOC)
    marks = spark.createDataFrame(labels, LABEL)
    got = {r.doc_id: r for r in quality_classifier.classify(spark, frame, marks).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 3 != 0) for i in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in quality_classifier.keep_good(spark, frame, marks).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


# all ---------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert packing.pack(spark, empty).count() == 0
    assert simhash.near_duplicates(spark, empty).count() == 0
    assert sharding.shard(spark, empty).count() == 0
    assert decontamination.matches(spark, empty, bench).count() == 0
    assert quality_rules.judge(spark, empty).count() == 0
    assert substring_dedup.digest(spark, empty).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, f"some words {i} " * 20, "en", "s", 1, 1, "x", 0.5) for i in range(12)]
    frame = spark.createDataFrame(rows, DOC + ", k int, score string, rank double")
    assert packing.pack(spark, frame).count() >= 12
    assert sharding.shard(spark, frame, 3, 4).count() == 12
    assert simhash.near_duplicates(spark, frame).count() == 12
    assert quality_rules.judge(spark, frame).count() == 12
    assert substring_dedup.strip_repeats(spark, frame).columns == frame.columns
    assert simhash.keep_one(spark, frame).columns == frame.columns
