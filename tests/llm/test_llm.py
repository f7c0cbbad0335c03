import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from fluvia.llm import exact_dedup, line_dedup, mixing, queries, sentencepiece_viterbi, simhash, suffix_repetition, token_orc, toxicity, warc_index, wordpiece_counts  # noqa: E402
from fluvia.llm.common import BATCH_BYTES, Bloom, in_arrow, slices  # noqa: E402
from fluvia.llm.graph import connected_components  # noqa: E402

PIECES, BYTE_PAIRS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, fl_x int"
LONG = "the long line of " * 9000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Some words here, and more."), (4, "Some words here, and more."), (5, "SOME words here, and more."), (None, "no id"), (6, LONG), (7, "é ü 中文   x"), (8, "a\x00b \x1c c")]


def docs(spark, rows=ODD, sources=("a", None)):
    return spark.createDataFrame([(i, t, "en", sources[k % len(sources)], len(t or ""), 7, 8) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(params=["odd", "empty"])
def table_of(request):
    return (lambda spark: docs(spark)) if request.param == "odd" else (lambda spark: docs(spark, []))


@pytest.mark.parametrize(
    "operator",
    [
        lambda d, lab: suffix_repetition.repetition(d),
        lambda d, lab: wordpiece_counts.token_counts(d, PIECES),
        lambda d, lab: token_orc.read_token_orc(d.sparkSession, token_orc.write_token_orc(d, BYTE_PAIRS)),
        lambda d, lab: line_dedup.dedup_lines(d),
        lambda d, lab: exact_dedup.exact_groups(d),
        lambda d, lab: toxicity.toxicity(d, lab),
        lambda d, lab: simhash.near_classes(d),
        lambda d, lab: sentencepiece_viterbi.coded(d, PIECES),
        lambda d, lab: sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(d, PIECES), PIECES),
        lambda d, lab: mixing.with_copies(d),
    ],
)
def test_one_row_for_each_row(spark, table_of, operator):
    rows = table_of(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1)], "doc_id bigint, toxic int")
    assert operator(rows, labels).count() == rows.count()


def test_other_operators_take_odd_tables(spark, table_of):
    rows = table_of(spark)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.drop_toxic(rows, labels).columns == rows.columns
    assert mixing.mix(rows).columns == rows.columns
    kept = simhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    if rows.count():
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(i for i in ids if i is not None) == [1, 4, 6, 7, 8] and ids.count(None) == 1


#: Names that the operators use inside, in their own spelling and others, and names that have to be quoted.
CLASHES = ["fl_x", "fl_maybe", "fl_bitmap", "fl_doc", "fl_hash", "fl_text_hash", "fl_id", "fl_heads", "fl_row", "fl_content", "fl_source", "fl_rate", "fl_target", "fl_copies", "fl_copy", "fl_score", "score", "own", "own0", "own_copies", "own_source", "row", "x0", "x3", "a.b", "a`b", "TEXT", "Doc_ID", "len", "sha", "content", "toxic", "fold", "h", "key", "node", "n", "hi", "ids"]


@pytest.mark.parametrize("half", [0, 1])
def test_names_that_clash_keep_their_values(spark, half):
    names = CLASHES[half::2] + ["text"] * half
    long = " ".join(f"w{k}" for k in range(40)) + "\nA line that three documents have in common"
    base = [(1, long, "a"), (2, long + " more", "b"), (3, "A line that three documents have in common", "b"), (4, None, None), (4, None, None)]
    shown = [(i, t, s, *(100 * i + k for k in range(len(names)))) for i, t, s in base]
    d = spark.createDataFrame(shown, ", ".join(["doc_id bigint", "text string", "source string"] + [f"c{k} bigint" for k in range(len(names))])).toDF("doc_id", "text", "source", *names)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for run in (line_dedup.dedup_lines, lambda x: toxicity.drop_toxic(x, labels), simhash.drop_near_duplicates, mixing.mix, lambda x: sentencepiece_viterbi.encode(x, PIECES, ids="out"), lambda x: sentencepiece_viterbi.coded(x, PIECES, ("n_tokens",)), mixing.with_copies, line_dedup.with_bitmaps):
        out = run(d)
        assert set(out.columns) >= set(names) - {"text"}
        for r in out.collect():
            values = dict(zip(reversed(out.columns), reversed(r), strict=True))
            assert all(values[c] == 100 * values["doc_id"] + k for k, c in enumerate(names) if out.columns.count(c) == 1 and c != "text")
    for run in (suffix_repetition.repetition, lambda x: wordpiece_counts.token_counts(x, PIECES), lambda x: token_orc.read_token_orc(spark, token_orc.write_token_orc(x, BYTE_PAIRS)), exact_dedup.exact_groups, lambda x: toxicity.toxicity(x, labels), simhash.near_classes, lambda x: warc_index.archive_index(x.toDF("page_id", "html", "url", *names))):
        assert run(d).count() == 5


# 1: WARC index merge


def test_archives_hold_each_page(spark):
    body = "<html>" + "x" * 200
    rows = [(3, "http://B.example.org:80/p?q=1", body), (2, "https://a.example.org", body), (9, "http://a.example.org/\r\nX", "short"), (5, None, None), (None, "u", body), (7, "http://c/", "p\r\n\r\nWARC/1.1\r\n" * 20)]
    got = warc_index.archive_index(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("part", "place").collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[3].record_type, by[3].refers_to, by[2].record_type) == ("revisit", 2, "response")
    assert by[None].record_type == "response" and by[5].payload_bytes == 0
    assert by[7].payload_digest == hashlib.sha256(rows[5][2].encode()).hexdigest()
    keys = [(r.url_key, r.capture) for r in got]
    assert keys == sorted(keys)
    assert by[3].url_key == "org,example,b)/p?q=1"


def test_offsets_can_be_sought(spark, monkeypatch):
    """A record is what lies at its offset, one gzip member that any tool reads; also one of over 16 MB."""
    import gzip
    from pathlib import Path

    monkeypatch.setattr(warc_index, "ARCHIVE_BYTES", 2000)
    rows = [(k, f"http://h{k % 7}.org/{k}", f"<p>{'body ' * (k % 50)}{k % 40}") for k in range(200)] + [(900, "http://big/", "y" * (17 << 20)), (901, "http://big/", "y" * (17 << 20)), (902, "http://z/", "é\x00" * 100)]
    folder = warc_index.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    index = warc_index.merge_runs(warc_index.capture_runs(spark, folder)).collect()
    by = {r[0]: r[2] for r in rows}
    assert len(index) == len(rows) and len({r.archive for r in index}) > 5
    for r in index:
        held = (Path(folder.removeprefix("file://")) / r.archive).read_bytes()
        warc, http, payload = warc_index.parse_record(gzip.decompress(held[r.offset : r.offset + r.length]))
        assert warc["X-Page-Id"] == str(r.page_id) and warc["WARC-Target-URI"] == r.url and int(http["Content-Length"]) == len(by[r.page_id].encode())
        assert payload == (b"" if r.record_type == "revisit" else by[r.page_id].encode())
    assert [r.refers_to for r in index if r.page_id == 901] == [900]
    files = [p for p in Path(folder.removeprefix("file://")).rglob("part-*")]
    assert sum(gzip.decompress(p.read_bytes()).count(b"X-Page-Id: ") for p in files) == len(rows)


def test_no_pages_no_index(spark):
    assert warc_index.archive_index(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc_index.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


# 2: suffix arrays


def test_suffix_repetition_is_brute_force():
    rng = random.Random(2)
    bodies = [" ".join(rng.choice("abc") + rng.choice(["", "\n"]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", "x " * 300, "q w e " * 40]
    got = suffix_repetition.measure(bodies)
    for i, text in enumerate(bodies):
        w = text.split()
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        assert got["n_repeat_words"][i] == len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)})
        longest = [max((next((k for k in range(len(w)) if max(p, q) + k >= len(w) or w[p + k] != w[q + k]), 0) for q in range(len(w)) if q != p), default=0) for p in range(len(w))]
        assert got["longest"][i] == max(longest, default=0)
        cover = {p + j for p, n in enumerate(longest) if n >= suffix_repetition.MIN_REPEAT for j in range(n)}
        assert got["n_covered"][i] == len(cover)
        lines = [x for x in text.split("\n") if x.strip()]
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert got["word_chars"][i] == sum(map(len, w)) and got["n_words"][i] == len(w)


def test_base_rule_and_verdict(spark):
    rng = random.Random(20)
    bodies = [" ".join(rng.choice(["a", "b#", "<c", "$$", "dd\n", "e|"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    bodies += [" ".join(f"w{k}" for k in range(60)), "x " * 80, " ".join(f"w{k % 30}" for k in range(90)), " ".join(f"w{k}" for k in range(100)) + " " + " ".join(f"w{k}" for k in range(30))]
    got = {r.doc_id: r for r in suffix_repetition.repetition(docs(spark, list(enumerate(bodies)))).collect()}
    for i, text in enumerate(bodies):
        w = text.split()
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)})
        longest = [max((next((k for k in range(len(w)) if max(p, q) + k >= len(w) or w[p + k] != w[q + k]), 0) for q in range(len(w)) if q != p), default=0) for p in range(len(w))]
        cover = len({p + j for p, n in enumerate(longest) if n >= 10 for j in range(n)})
        assert got[i].n_symbols == sum(text.count(c) for c in "#*$%&|<>") and got[i].n_repeat_words == again
        assert got[i].base_failed == (len(w) < 50 or 100 * again > 50 * len(w))
        top = max(longest, default=0)
        assert got[i].kept == (not got[i].base_failed and cover <= 0.4 * len(w) and (top < 10 or top <= 0.25 * len(w)))
        # Longest repeats that aren't the rest of the one a word before.
        assert got[i].n_repeats == sum(n >= 10 and (not k or longest[k - 1] != n + 1) for k, n in enumerate(longest))


def test_maximal_repeats():
    assert suffix_repetition.maximal_repeats("a b c x a b c".split()) == [(0, 3), (4, 3)]
    assert suffix_repetition.maximal_repeats([]) == []


# 3: word pieces


def test_word_pieces_are_the_library_s():
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece

    start, inner = wordpiece_counts.vocabulary(PIECES)
    vocab = {p: i for i, p in enumerate(["[UNK]", *sorted(start), *("##" + p for p in sorted(inner))])}
    library = Tokenizer(WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10_000))
    counter = wordpiece_counts.PieceCounter(start, inner)
    rng = random.Random(3)
    words = ["".join(rng.choice("abeinorst é中ßx9_") for _ in range(rng.randrange(1, 14))).replace(" ", "") or "a" for _ in range(3000)] + ["unbelievable", "z" * 500]
    for w in words:
        tokens = library.encode(w).tokens
        assert counter.count(w) == (-1 if tokens == ["[UNK]"] else len(tokens)), w


# 4: token ORC


def test_word_encoder_is_the_library(spark):
    encoder = token_orc.WordEncoder(BYTE_PAIRS, 50)
    rng = random.Random(4)
    parts = ["a", "B", " ", "\n", ".", "'s", "é", "1", "\t", "!", "<|endoftext|>", " the", "_", "\0", "　", "中"]
    bodies = ["", " ", "a  b", *("".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500))]
    want = [e.ids for e in encoder.tokenizer.encode_batch(bodies, add_special_tokens=False)]
    got = []
    for k in range(0, len(bodies), 50):
        ids, n = encoder.encode(pa.array(bodies[k : k + 50]))
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == want


def test_token_orc_round_trip(spark):
    rows = docs(spark)
    path = token_orc.write_token_orc(rows, BYTE_PAIRS)
    got = sorted(token_orc.read_token_orc(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert got[1].ids == [2] and got[7].n_tokens == len(got[7].ids)
    plan = token_orc.read_token_orc(spark, path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_id,5)" in plan
    crc = {r.doc_id: r.ids_crc32 for r in token_orc.ids_crc32(token_orc.read_token_orc(spark, path), ["doc_id"]).collect()}
    assert crc[1] == zlib.crc32(np.array([2], "<u4").tobytes())


# 5: line dedup


def brute_lines(rows):
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(key) >= 20:
                keys.setdefault(key, set()).add(i)
    out = {}
    for i, t in rows:
        kept = [line for line in (t or "").split("\n") if not (len(d := keys.get(line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), ())) >= 3 and i != max(d))]
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_line_dedup_is_brute_force(spark, partitions):
    rng = random.Random(5)
    lines = [f"A shared Line, number {k} of them" for k in range(12)] + ["short", "", "ééééééééééééééééééé", "  A shared line, number 3 of them\t"]
    rows = [(i, "\n".join(rng.choice(lines[: 1 + i % 16] + [f"own line {i} which nobody else has"]) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_lines(rows)


# 6: exact dedup


def test_full_texts_are_hashed_for_survivors_only(spark):
    rows = docs(spark, [(1, "a" * 70 + "x"), (2, "A" * 70 + "x"), (3, "b" * 71), (4, "other length"), (5, "c" * 200)])
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_groups(rows).collect()}
    assert {i for i, sha in got.items() if sha} == {1, 2}
    plan = exact_dedup.exact_groups(rows)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan


def test_exact_groups(spark):
    rows = [(i, t) for i, t in enumerate(["Same", "same", "sAME", "other", "ÉÉ", "éé", "x" * 70 + "a", "x" * 70 + "b", None, ""])] + [(1, "same"), (None, "same")]
    got = exact_dedup.exact_groups(docs(spark, rows), digest_all=True).collect()
    group = [r for r in got if r.text_sha256 == hashlib.sha256(b"same").hexdigest()]
    assert len(group) == 5 and {r.group_size for r in group} == {5} and {r.keep_id for r in group} == {2} and sum(r.kept for r in group) == 1
    assert all(r.group_size == 1 and r.kept for r in got if r.doc_id in (3, 4, 5, 6, 7))
    assert {r.keep_id for r in got if r.doc_id in (8, 9)} == {9}


# 7: toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    words = ["lo", "rem", "ipsum", "dolor", "you", "the"]
    rows = [(i, " ".join(rng.choice([*words, "idiot", "stupid"] if i % 4 == 0 else words) for _ in range(60))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(held) > 60 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_isotonic_map_never_falls():
    model = toxicity.Trees().fit(np.random.default_rng(1).normal(size=(300, 3)), np.array([0, 1, 1] * 100, float))
    model.calibrate(np.arange(300.0), np.array([0, 1, 0] * 100, float))
    assert (np.diff(np.interp(np.arange(300), *model.steps)) >= -1e-12).all()


def test_lexicon_is_learned_from_labels(spark):
    """Insults that no list has, in whole words and in stems with many endings, hidden and shouted ones too."""
    rng = random.Random(17)
    plain = [f"word{k}" for k in range(300)]
    ends = [a + b for a in "aeiou" for b in "nrstl"]
    bad = ["zorblax", "quiffle"] + ["vrunk" + e for e in ends]
    rows = [(i, " ".join([*rng.choices(plain, k=50), *(rng.choices(bad, k=4) if i % 5 == 0 else [])])) for i in range(900)]
    model = toxicity.train(docs(spark, rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id bigint, toxic int"))
    clean = " ".join(rng.choices(plain, k=50))
    other = [clean, clean + " zorblax quiffle vrunkas", clean + " vrunkol vrunkuz vrunkeb", "", None]
    score = model.score(other)
    assert (score >= 0.5).tolist() == [False, True, True, False, False]
    at = {n: toxicity.FEATURES.index(n) for n in ("hidden", "shouted_hits", "near_second", "stretched_words")}
    f = lambda t: model.lexicon.features([t])[0]
    assert f("a z0rbl@x b")[at["hidden"]] > 0 and f("a z.o.r.b.l.a.x b")[at["hidden"]] > 0 and f("z o r b l a x")[at["hidden"]] > 0 and f("zorblaaaax")[at["hidden"]] > 0
    assert f("a ZORBLAX!")[at["shouted_hits"]] > 0 and f("you zorblax")[at["near_second"]] > 0 and f("you a b c d e f zorblax")[at["near_second"]] == 0
    assert f("word1 word2")[at["hidden"]] == 0


def test_without_labels_nothing_is_toxic(spark):
    rows = docs(spark, [(1, "clean words"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity(rows, none).collect()] == [(0.0, 0)] * 2
    assert toxicity.drop_toxic(rows, none).count() == 2
    assert toxicity.drop_toxic(rows, spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")).count() == 2


def test_toxicity_of_planted_words(spark):
    """Held-out rows of the sample table: whole recall and clean share, each language by itself where it has rows."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    for _, some in [(None, rows), *rows.groupby("lang")]:
        assert some.predicted[some.toxic == 1].mean() >= 0.88 and 1 - some.predicted[some.toxic == 0].mean() >= 0.97
    assert rows.predicted[rows.toxic == 1].mean() >= 0.9


# 8: SimHash


def brute_components(fp, radius):
    label = list(range(len(fp)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(fp)), 2):
        if (int(fp[a]) ^ int(fp[b])).bit_count() <= radius:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("most", [4096, 3])
def test_near_links_lose_none(spark, most):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    fp = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for s in seeds for _ in range(12)} | {seeds[0] ^ (k << 20) for k in range(40)})
    signed = np.array(fp, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, rep bigint")
    parts = {r.node: r.component for r in connected_components(simhash.near_links(nodes, 3, simhash.HALVES, most)).collect()}
    assert [parts.get(i, i) for i in range(len(fp))] == brute_components(fp, 3)


def test_wider_segments_find_all_within_eight_bits():
    rng = random.Random(9)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), 8))
        _, keys = simhash.FIFTHS.entries(np.array([a], np.uint64))
        _, others = simhash.FIFTHS.entries(np.array([b], np.uint64))
        assert {*keys.tolist()} & {*others.tolist()}


def near_groups(spark, bodies, similarity=0.8):
    """What a brute force over all pairs keeps, and what the operator keeps."""
    sets = [frozenset(simhash.shingles(t.encode(), 5)) for t in bodies]
    head = list(range(len(bodies)))
    for a, b in combinations(range(len(bodies)), 2):
        common = len(sets[a] & sets[b])
        if common >= similarity * (len(sets[a]) + len(sets[b]) - common) and head[a] != head[b]:
            x, y = sorted((head[a], head[b]))
            head = [x if h == y else h for h in head]
    kept = simhash.drop_near_duplicates(docs(spark, list(enumerate(bodies)))).select("doc_id").collect()
    return set(head), {r.doc_id for r in kept}


def variants(rng, n, words, changed):
    """Texts that differ from one text of ``words`` words in ``changed`` words each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(words), changed):
            w[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_every_pair_of_a_group_of_variants_is_compared(spark):
    """Variants lie about the similarity: links between them are rejected and found by chance."""
    rng = random.Random(12)
    bodies = [t for words, changed, n in ((200, 3, 250), (120, 2, 200), (100, 2, 150)) for t in variants(rng, n, words, changed)]
    want, got = near_groups(spark, bodies)
    assert 30 < len(want) < len(bodies) - 30
    assert got == want


@pytest.mark.parametrize("block", [3, 500])
def test_missed_links_join_what_all_pairs_join(spark, block):
    rng = random.Random(13)
    nodes = [(i, np.unique(np.array([rng.randrange(14) for _ in range(12)], np.uint64))) for i in range(60)]
    groups = spark.createDataFrame([(k, i, 0, len(range(k, 60, 2))) for k in (0, 1) for i in range(k, 60, 2)], "key bigint, node bigint, low bigint, n bigint")
    grams = spark.createDataFrame([(i, g.tobytes()) for i, g in nodes], "node bigint, grams binary")
    parts = spark.createDataFrame([], "node bigint, component bigint")
    links = {(min(r), max(r)) for r in simhash.missed_links(groups, parts, grams, 0.8, block).collect()}
    near = {(i, j) for (i, x), (j, y) in combinations(nodes, 2) if (j - i) % 2 == 0 and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))}
    assert links and links <= near
    roots = lambda pairs: {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(pairs), "u bigint, v bigint")).collect()}
    assert roots(links) == roots(near)


def test_pairs_are_found_from_the_similarity_on(spark):
    """300 pairs at 0.8 to 0.83, where one fingerprint finds half."""
    rng = random.Random(14)
    bodies = []
    while len(bodies) < 600:
        two = variants(rng, 2, 60 + len(bodies) // 2, 0)
        w = two[1].split()
        sets = [frozenset(simhash.shingles(two[0].encode(), 5))] * 2
        while True:
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
            new = frozenset(simhash.shingles(" ".join(w).encode(), 5))
            if len(sets[0] & new) < 0.8 * len(sets[0] | new):
                break
            sets[1] = new
            two[1] = " ".join(w)
        if len(sets[0] & sets[1]) < 0.83 * len(sets[0] | sets[1]):
            bodies += two
    want, got = near_groups(spark, bodies)
    assert len(want) == 300 and got == want


def test_near_copies_of_the_sample_table(spark):
    """Pairs of different texts at 0.8 and more in sf0.1, found by their shingles: one text of each group stays."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets: dict[frozenset, int] = {}
    for i, t in rows.select("doc_id", "text").orderBy("doc_id").collect():
        sets.setdefault(frozenset(simhash.hashes((t or "").encode(), 5).tolist()), i)
    ids, grams = list(sets.values()), list(sets)
    at: dict[int, list[int]] = {}
    for k, g in enumerate(grams):
        for x in g:
            at.setdefault(x, []).append(k)
    pairs = set()
    for k, g in enumerate(grams):
        common: dict[int, int] = {}
        for x in g:
            for j in at[x]:
                if j > k:
                    common[j] = common.get(j, 0) + 1
        pairs |= {(k, j) for j, n in common.items() if n >= 0.8 * (len(g) + len(grams[j]) - n)}
    label = list(range(len(ids)))
    for a, b in sorted(pairs) * 4:
        label[a] = label[b] = min(label[a], label[b])
    want = {i for k, i in enumerate(ids) if label[k] == k}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(rows).select("doc_id").collect()}
    assert len(pairs) > 40 and len(ids) - len(want) > 30
    # Every text that goes has a partner, and at least 0.9 of those that have to go do (exact copies don't count).
    gone = {i for i in ids if i not in kept}
    must = {i for i in ids if i not in want}
    print("pairs", len(pairs), "must go", len(must), "gone", len(gone), "found", len(gone & must))
    assert gone <= must and len(gone & must) >= 0.9 * len(must)


def test_repeated_ids_with_other_texts_stay(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, one), (1, two), (1, two.upper()), (2, two), (3, three), (3, one + " more"), (4, three)]
    got = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in got) == [(1, one), (1, two), (3, three)]


def test_fingerprint_counts_the_bits_of_all_shingles():
    rng = random.Random(18)
    for n in (1, 2, 3, 4, 5, 9, 40, 300):
        words = [rng.choice("aBcdE") + rng.choice("xyz") for _ in range(n)]
        low = [w.lower() for w in words]
        parts = [" ".join(low[k : k + 3]) for k in range(n - 2)] if n > 3 else [" ".join(low)]
        import xxhash

        h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(simhash.hashes("  ".join(words).encode(), 3)) == want


def test_fingerprint_and_classes(spark):
    assert simhash.fingerprint(simhash.hashes(b"", 3)) == 0
    one = simhash.hashes(b"One two", 3)
    assert len(one) == 1 and simhash.fingerprint(one) == int(one[0])
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs(spark)).collect()}
    assert (got[1], got[2], got[3], got[4], got[5], got[None]) == (1, 1, 1, 4, 4, None)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001), (1000, 1000), (None, 4)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert connected_components(links.where("a < 0")).count() == 0


# 9: mixing


def test_mixture(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(1, 40)) for i in range(3000)]
    sources = [*"aaaaab", None, "c"]
    got = mixing.with_copies(docs(spark, rows, sources)).withColumn("size", F.regexp_count("text", F.lit(mixing.WORD)))
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("fl_copies")).alias("taken"), F.first("fl_target").alias("target"), F.max("fl_copies").alias("most")).collect()}
    total = sum(r.size for r in by.values())
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6 * total
    for r in by.values():
        assert r.target <= 3 * r.size + 1e-6 and r.most <= 3 and abs(r.taken - r.target) < 0.08 * r.target
    again = mixing.with_copies(docs(spark, rows, sources).repartition(7))
    assert sorted(map(tuple, again.select("doc_id", "fl_copies").collect())) == sorted(map(tuple, got.select("doc_id", "fl_copies").collect()))
    assert mixing.mix(docs(spark, rows, sources)).count() == got.agg(F.sum("fl_copies")).first()[0]


def test_targets_fill_to_their_ends(spark):
    rows = [(1, "w"), (2, "w " * 10), (3, "w " * 1000), (4, "")]
    got = {r.source: r for r in mixing.source_rates(docs(spark, rows, ["a", "b", "c", None])).collect()}
    assert (got["a"].target, got["b"].target, got[None].target) == (3.0, 30.0, 0.0) and abs(got["c"].target - 978) < 1e-9


# 10: SentencePiece


def test_viterbi_is_brute_force():
    rng = random.Random(11)
    pieces = [(p, -rng.random() * 5, i) for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aab", "▁ab", "bb", "abab", "▁▁", "c"])]
    codec = sentencepiece_viterbi.Codec(pieces, {}, 99, 100)
    score = {p: s for p, s, _ in pieces}

    def best(chunk):
        if not chunk:
            return 0.0
        tries = [score[chunk[:k]] + best(chunk[k:]) for k in range(1, len(chunk) + 1) if chunk[:k] in score]
        return max([*tries, *([] if chunk[0] in score else [codec.unknown_score + best(chunk[1:])])])

    by_id = {i: p for p, _, i in pieces}
    for _ in range(300):
        chunk = "".join(rng.choice("▁abcz") for _ in range(rng.randrange(1, 10)))
        ids = codec.segment([chunk])[0].tolist()
        assert abs(sum(score[by_id[i]] if i in by_id else codec.unknown_score for i in ids) - best(chunk)) < 1e-9


def test_viterbi_never_scores_below_the_library():
    """The library reads the same pieces as a unigram model; its segmentation may score less, never more."""
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = sentencepiece_viterbi.codec(PIECES)
    total = lambda ids: sum(model.pieces[i].score for i in ids)
    rng = random.Random(12)
    words = "the of and ing tion er on house Straße élan niño water 42 x".split()
    for _ in range(400):
        text = " ".join(rng.choice(words) + rng.choice(["", "s", ",", "ly"]) for _ in range(rng.randrange(1, 8)))
        own = codec.encode([text])[0].tolist()
        assert total(own) >= total(library.encode(text)), text
        assert library.decode(own) == text


def test_round_trip(spark):
    got = {r.doc_id: r for r in sentencepiece_viterbi.coded(docs(spark), PIECES).collect()}
    assert all(r.round_trip for r in got.values()) and got[6].decoded == LONG and got[1].n_tokens == 0
    codec = sentencepiece_viterbi.codec(PIECES)
    rng = random.Random(13)
    bodies = ["".join(rng.choice(" \nab.é中😀\x00▁") for _ in range(rng.randrange(12))) for _ in range(900)]
    for k in range(0, len(bodies), 30):
        some = bodies[k : k + 30]
        ids, n = codec.encode(some)
        assert codec.decode(ids, n) == [t.replace("▁", " ") for t in some]
        # A text's ids don't depend on what else is encoded with it.
        alone = [codec.encode([t])[0].tolist() for t in some]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == alone


def test_words_side_by_side_are_the_same_as_one_by_one():
    rng = random.Random(19)
    pieces = [(p, -rng.random() * 5, i) for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aab", "▁ab", "bb", "abab", "▁▁", "c"])]
    codec = sentencepiece_viterbi.Codec(pieces, {b: 20 + b for b in range(256)}, 19, 300)
    chunks = ["".join(rng.choice("▁abcé") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    ids, n = codec.segment(chunks)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [codec.segment([c])[0].tolist() for c in chunks]


# shared


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(500)
    bloom = Bloom(keys, F.xxhash64("id"))
    got = spark.range(4000).where(bloom.may_hold(F.xxhash64("id")))
    assert got.where("id < 500").count() == 500 and got.count() < 800


def test_slices_keep_order_and_bounds():
    batches = [pa.RecordBatch.from_pydict({"t": ["x" * n for n in sizes]}) for sizes in ([1, 50, 2], [], [300], [3, 3, 3])]
    parts = [p.column("t").to_pylist() for p in slices(batches, "t", 60)]
    assert [len(x) for p in parts for x in p] == [1, 50, 2, 300, 3, 3, 3]
    assert all(sum(map(len, p)) <= 60 or len(p) == 1 for p in parts)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs_.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    one = corpus_pipeline.drop_toxic(spark, docs_, sf)
    two = corpus_pipeline.dedup_lines(spark, one, sf)
    assert two.count() == one.count()
    three = corpus_pipeline.drop_near_duplicates(spark, two, sf)
    texts = {r.doc_id: r.text for r in two.collect()}
    grams = {}
    for i, t in texts.items():
        w = t.lower().split()
        grams[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) > 5 else frozenset([tuple(w)])
    similar = {}
    for a, b in combinations(sorted(texts), 2):
        common = len(grams[a] & grams[b])
        similar[a, b] = common / (len(grams[a]) + len(grams[b]) - common)
    kept = {r.doc_id for r in three.collect()}
    gone = set(texts) - kept
    # Who goes has a partner at the similarity, and of near copies well above it one stays at most.
    assert all(max(s for pair, s in similar.items() if i in pair) >= 0.8 for i in gone)
    assert gone and not [pair for pair, s in similar.items() if s >= 0.9 and kept.issuperset(pair)]
    four = corpus_pipeline.mix_sources(spark, three, sf)
    assert one.columns == two.columns == three.columns == four.columns == columns
    five = corpus_pipeline.encode(spark, four, sf)
    assert five.count() == four.count() and five.where("not round_trip").count() == 0


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()][:10] == [f"op{k}" for k in range(1, 11)] and "pipeline" in queries.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_arrow_batches_are_bounded(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    long = spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 18).alias("text"))
    got = long.transform(in_arrow, run, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 100 and max(r.size for r in got) <= BATCH_BYTES + (1 << 19)
