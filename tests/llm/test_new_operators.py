import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from fluvia.llm import cascade, periodic_runs, queries, setsketch, simhash  # noqa: E402
from fluvia.llm.graph import connected_components  # noqa: E402

WORDS = ("tide", "bank", "Sand", "river", "silt", "mud")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "a b"), (5, "A B"), (None, "no id"), (6, "the long line of " * 9000), (7, "é ü 中文   x"), (8, "a\x00b \x1c c")]


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# --- periodic runs


def plain_runs(w, least, periods):
    """By comparing every word with that p words on, for each period p; those of a smaller period don't count."""
    n, out = len(w), []
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            smaller = any(all(w[start + k] == w[start + k + q] for k in range(length - q)) for q in range(1, p))
            if length >= max(least, periods * p) and not smaller:
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, longest):
    n, kinds = rng.randint(0, longest), rng.randint(1, 4)
    if rng.random() < 0.5:
        return [rng.randrange(kinds) for _ in range(n)]
    out = []
    while len(out) < n:
        out += [rng.randrange(kinds) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
    return out


def test_runs_are_those_of_plain_comparison():
    rng = random.Random(1)
    for _ in range(4000):
        w, least, periods = some_words(rng, 70), rng.choice([2, 4, 9]), rng.choice([3, 3, 4])
        assert periodic_runs.runs(w, least, periods) == plain_runs(w, least, periods), w


def test_lyndon_edges_share_what_suffixes_share():
    rng = random.Random(2)
    for _ in range(1500):
        x = some_words(rng, 40)
        n = len(x)
        after = [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) for i in range(n)]
        before = [next((i for i in range(j - 1, -1, -1) if x[i:] < x[j:]), -1) for j in range(n)]
        common = lambda i, j: next((k for k in range(n - j) if x[i + k] != x[j + k]), n - j)  # noqa: E731, B023
        pairs = {(i, after[i]) for i in range(n) if after[i] < n} | {(before[j], j) for j in range(n) if before[j] >= 0}
        want = {(i, j, common(i, j)) for i, j in pairs if common(i, j) >= j - i}
        assert set(periodic_runs.lyndon_edges(x)) == want


def test_the_work_is_linear_in_the_words():
    """Words are counted when they are compared: each list asks for no more than some for each position."""

    class Word(int):
        seen = 0

        def __eq__(self, other):
            Word.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for x in ([1] * 3000, [k % 300 for k in range(3000)], fibonacci[1][:3000], [k % 7 // 6 for k in range(3000)]):
        Word.seen = 0
        periodic_runs.lyndon_edges([Word(v) for v in x])
        assert Word.seen <= 3 * len(x)


def plain_op11(i, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = plain_runs(words, 24, 3)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(((-length / q, s, q, length) for s, length, q in found), default=(None,) * 4)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), best[1], best[3], best[2], None if not found else 1000 * best[3] // best[2], digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_op11_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    rows += [(i, " ".join(WORDS[k] for k in some_words(rng, 150))) for i in range(60, 200)] + [(200, None), (201, ""), (202, " \n")]
    folder = save(spark, tmp_path, "documents", rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op11_periodic_runs(spark, folder).collect()}
    assert got == {i: plain_op11(i, t) for i, t in rows}
    assert sum(v[0] > 0 for v in got.values()) > 60


def test_runs_of_odd_tables(spark, tmp_path):
    rows = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id bigint, text string, FL_RUNS int")
    got = periodic_runs.with_runs(rows)
    assert got.columns == ["doc_id", "text", "FL_RUNS", "fl_n_words", "fl_runs", "fl_collapsed"]
    by_id = {r[0]: r for r in got.collect()}
    assert got.count() == len(ODD) and by_id[6][4] == [(0, 36000, 4)] and by_id[6][5] == "the long line of"
    assert by_id[1][3:] == (0, [], "") and by_id[3][3:] == (0, [], "")
    back = periodic_runs.collapse_runs(rows)
    assert back.columns == rows.columns and {r[0]: r[1] for r in back.collect()}[8] == ODD[-1][1]
    assert periodic_runs.with_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs([1, 1], 1, 2)


# --- SetSketch


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    for common in (0, 40, 300, 1200, 2900):
        u, v = (rng.integers(0, 1 << 63, 3000, np.uint64) for _ in range(2))
        v[:common] = u[:common]
        a, b = setsketch.registers(u), setsketch.registers(v)
        assert (setsketch.merge(a, b) == setsketch.registers(np.union1d(u, v))).all()
        best, _, _ = setsketch.estimated(a[None], b[None], np.array([3000.0]), np.array([3000.0]))
        real = common / (6000 - common)
        assert abs(best[0] - real) < 0.15
        assert setsketch.may_reach(a[None], b[None], np.array([3000.0]), np.array([3000.0]), 0.8)[0] or real < 0.8
    assert (setsketch.registers(np.zeros(0, np.uint64)) == 0).all()


def test_no_pair_at_the_similarity_is_ruled_out():
    rng = np.random.default_rng(5)
    ruled = 0
    for _ in range(400):
        n = int(rng.integers(5, 400))
        common = -(-8 * n // 9)
        u = rng.integers(0, 1 << 63, n, np.uint64)
        near = np.append(u[:common], rng.integers(0, 1 << 63, n - common, np.uint64))
        far = np.append(u[: n // 3], rng.integers(0, 1 << 63, n - n // 3, np.uint64))
        a, b, c = (setsketch.registers(x) for x in (u, near, far))
        size = np.array([float(n)])
        assert setsketch.may_reach(a[None], b[None], size, size, 0.8)[0]
        ruled += not setsketch.may_reach(a[None], c[None], size, size, 0.8)[0]
    assert ruled > 350


def plain_groups(rows, size=4):
    grams = [frozenset(simhash.shingles((t or "").encode(), size)) for _, t in rows]
    part = list(range(len(rows)))

    def top(k):
        while part[k] != k:
            k = part[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
            part[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return sorted(((i, len(g), low.get(top(k)) if g else i) for k, ((i, _), g) in enumerate(zip(rows, grams, strict=True))), key=repr)


@pytest.mark.parametrize("block", [6, 512])
def test_near_groups_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rng = random.Random(6)
    rows = []
    for words, changed, n in ((120, 3, 60), (60, 2, 60), (30, 1, 30), (6, 1, 20)):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(words)]
        for _ in range(n):
            w = list(base)
            for k in rng.sample(range(words), rng.randint(0, changed)):
                w[k] = f"x{rng.randrange(10**6)}"
            rows.append((1000 - len(rows), " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(2000 + k, f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(40))}") for k in range(60)]
    rows += ODD + [(None, rows[3][1]), (None, "no id")]
    got = setsketch.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_groups(rows)
    assert setsketch.near_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_text_without_an_id_joins_its_neighbours(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(1, base), (None, base[:3] + ["a"] + base[4:]), (2, base[:3] + ["a"] + base[4:56] + ["b"] + base[57:])]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = setsketch.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows) and {r.component_id for r in got} == {1}


# --- SimHash: a fingerprint of rows without ids


def test_a_fingerprint_without_ids_is_a_bridge(spark, monkeypatch):
    prints = spark.createDataFrame([(1, 0, 0), (None, 7, 0), (2, 63, 0), (3, -1, 0), (None, -2, 0), (None, 0x0F0F0F0F, 0)], "doc_id bigint, fp bigint, content bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **b: prints)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_classes(None).collect()}
    assert got == {(1, 0): 1, (None, 7): 1, (2, 63): 1, (3, -1): 3, (None, -2): 3, (None, 0x0F0F0F0F): None}


def test_longer_keys_lose_no_link_of_a_hot_key(spark):
    rng = random.Random(7)
    sets = [np.unique(np.array([rng.randrange(14) for _ in range(12)], np.uint64)) for _ in range(60)]
    groups = spark.createDataFrame([(5, i, 0, 60) for i in range(60)], "key bigint, node bigint, low bigint, n bigint")
    grams = spark.createDataFrame([(i, g.tobytes()) for i, g in enumerate(sets)], "node bigint, grams binary")
    keys = spark.createDataFrame([(i, simhash.bands(g).tobytes()) for i, g in enumerate(sets)], "node bigint, packed binary")
    none = spark.createDataFrame([], "node bigint, component bigint")
    near = {(i, j) for (i, x), (j, y) in combinations(enumerate(sets), 2) if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))}
    roots = lambda pairs: {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(pairs), "u bigint, v bigint")).collect()}
    links = {(min(r), max(r)) for r in simhash.missed_links(groups, none, grams, 0.8, 4, keys).collect()}
    assert links <= near and roots(links) == roots(near)


# --- cascade


def plain_cascade(rows):
    """One conversation after the other, one turn after the other."""
    out, talks = [], {}
    for c, t, x in rows:
        talks.setdefault(c, []).append((t, x))
    for c, turns in talks.items():
        turns.sort(key=lambda r: r[0])
        state = []
        for p, (t, _) in enumerate(turns):
            h = lambda k: zlib.crc32(f"{k}:{c}:{t}".encode())  # noqa: E731, B023
            far = h(0) % 5
            parent = state[p - far] if far and far <= p else None
            if parent and parent[0] != "delivered":
                state.append(("blocked", 0, None, None))
                continue
            begun = at = max(7 * p, parent[3]) if parent else 7 * p
            status, a = "delivered", 1
            while h(1) % 101 < 50 and (at < 7 * p + h(2) % 101 or h(a + 2) % 3 == 0):
                if a == 6:
                    status = "dead"
                    break
                at += 10 * 2 ** (a - 1)
                a += 1
            state.append((status, a, begun, at))
        no = {p: k + 1 for k, (_, p) in enumerate(sorted((s[3], p) for p, s in enumerate(state) if s[0] == "delivered"))}
        total, sums = 0, {}
        for p in no:
            total += no[p] * zlib.crc32((turns[p][1] or "").encode())
            sums[p] = (total + (1 << 63)) % (1 << 64) - (1 << 63)
        out += [(c, turns[p][0], *s, no.get(p), sums.get(p)) for p, s in enumerate(state)]
    return sorted(out)


def test_op13_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, rng.choice([None, "", "yes", "nö", "a b c"])) for c, n in ((1, 3000), (2, 1), (-3, 400), (4, 700)) for t in rng.sample(range(-50, 2 * n), n)]
    rng.shuffle(rows)
    folder = save(spark, tmp_path, "conversations", rows, "conv_id bigint, turn bigint, text string")
    got = sorted(map(tuple, queries.op13_cascade(spark, folder).collect()))
    want = plain_cascade(rows)
    assert got == want
    assert {r[2] for r in want} == {"delivered", "dead", "blocked"} and sum(r[2] == "blocked" for r in want) > 30


@pytest.mark.parametrize("block", [1, 5, 64])
def test_blocks_and_parts_change_nothing(spark, block):
    rng = random.Random(9)
    rows = [(c, p, p - rng.randint(0, 30), 7 * p, rng.choice([None, 7 * p + 50]), rng.randrange(64), rng.randrange(1 << 32)) for c in (1, 2) for p in range(200)]
    turns = spark.createDataFrame(rows, "conv bigint, p bigint, parent bigint, arrival bigint, repair bigint, fails int, weight bigint")
    want = cascade.released(turns, 1000).collect()
    got = cascade.released(turns, block, block_rows=10).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r.status for r in want} == {"delivered", "dead", "blocked"}


def test_sums_go_on_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(cascade, "FAN", 3)
    rng = random.Random(10)
    rows = [(1, k, rng.randrange(1 << 32)) for k in range(300)] + [(2, 0, 5)]
    got = cascade.running(spark.createDataFrame(rows, "conv bigint, at bigint, w bigint"), ["at"], "w", 10).collect()
    total, want = 0, [(2, 0, 1, 5)]
    for k in range(300):
        total += (k + 1) * rows[k][2]
        want.append((1, k, k + 1, total))
    assert sorted((r.conv, r["at"], r.fl_no, r.fl_state) for r in got) == sorted(want)


def test_a_long_chain_crosses_blocks(spark):
    turns = spark.range(40).select(F.lit(1).cast("bigint").alias("conv"), F.col("id").alias("p"), (F.col("id") - 1).alias("parent"), (7 * F.col("id")).alias("arrival"), F.when(F.col("id") == 25, 500).cast("bigint").alias("repair"), F.lit(63).alias("fails"), F.lit(1).cast("bigint").alias("weight"))
    got = {r.p: r for r in cascade.released(turns, 8).collect()}
    assert [got[p].status for p in range(40)] == ["delivered"] * 25 + ["dead"] + ["blocked"] * 14
    assert got[24].last_at == 168 and got[25].last_at == 175 + 310 and got[25].attempts == 6 and got[24].state == 325
    assert cascade.released(turns.limit(0)).count() == 0


def test_odd_conversations(spark, tmp_path):
    rows = [(None, 0, "x"), (None, 1, None), (5, None, "y"), (5, 0, "z"), (5, 0, "z")]
    folder = save(spark, tmp_path, "conversations", rows, "conv_id bigint, turn bigint, text string")
    got = queries.op13_cascade(spark, folder).collect()
    assert len(got) == 5 and {r.conv_id for r in got} == {None, 5}


# --- SentencePiece: a model's own normalizer


def unigram_model(path, **spec):
    """A unigram model put together by hand: letters, some words, and the given normalizer."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.normalizer_spec.CopyFrom(pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=spec.pop("rule", "identity")).serialized_model_proto()).normalizer_spec)
    for k, v in ({"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True} | spec).items():
        setattr(model.normalizer_spec, k, v)
    model.trainer_spec.model_type = 1
    for k, (piece, kind) in enumerate((("<unk>", 2), ("<s>", 3), ("</s>", 3))):
        model.pieces.add(piece=piece, score=0.0, type=kind)
    rng = random.Random(11)
    for piece in ["▁", *"abcdefghijklmnop", "ab", "▁a", "▁ab", "cd", "▁the", "ing", "hop", "▁op", "no", "mno"]:
        model.pieces.add(piece=piece, score=-rng.uniform(1, 9) * 1.37, type=1)
    model.trainer_spec.vocab_size = len(model.pieces)
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("spec", [{}, {"rule": "nmt_nfkc"}, {"rule": "nfkc_cf", "remove_extra_whitespaces": False}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": False}])
def test_ids_of_a_unigram_model_are_the_librarys(tmp_path, spec):
    import sentencepiece

    from fluvia.llm.sentencepiece_viterbi import Codec

    path = unigram_model(tmp_path / "u.model", **spec)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), Codec.from_file(path)
    rng = random.Random(12)
    odd = ["a  b", " ab", "ab ", "ａｂ c", "a\tb", "ab\ncd", "AB ab", "", " ", "éab", "xyz ab zz q", "▁ab▁ ▁c", "①②", "ﬁ ab"]
    bodies = odd + ["".join(rng.choice("abcdmno  hopingＡ\t\nzé") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    flat, n = own.encode(bodies)
    got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [library.encode(t) for t in bodies]


def test_round_trips_are_of_normalised_texts(spark, tmp_path):
    from fluvia.llm.sentencepiece_viterbi import coded

    path = unigram_model(tmp_path / "u.model", rule="nmt_nfkc")
    rows = spark.createDataFrame([(1, "ab  cd"), (2, " ａｂ"), (3, "ab z"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in coded(rows, path).collect()}
    assert got[1].decoded == "ab cd" and got[2].decoded == "ab" and got[1].round_trip and got[2].round_trip and got[4].round_trip and not got[3].round_trip


# --- toxicity: features and trees against plain versions

import re  # noqa: E402

from fluvia.llm import toxicity  # noqa: E402


def plain_features(text, weight):
    """The features of one text, word after word."""
    text = text or ""
    if not text:
        return [0.0] * len(toxicity.FEATURES)
    tokens = re.split(r"\s+", text)
    tokens = [t for t in tokens if t]
    n = max(1, len(tokens))
    facts = []
    for t in tokens:
        core = t.rstrip(".,;:!?")
        core = core if core.isupper() else core.lower()
        core = core or t
        plain, hidden, flags = toxicity.words_of(core)
        best = max(((weight.get(w, 0.0), w) for w in plain), default=(0.0, ""))
        veiled = 0
        if hidden and best[0] <= 0:
            other = max((weight.get(w, 0.0), w) for w in hidden)
            if other[0] > 0:
                best, veiled = other, 1
        starts = [(weight.get(f"{w[:k]}*", 0.0), f"{w[:k]}*") for w in plain for k in range(4, 9) if k < len(w)]
        start = max([s for s in starts if s[0] > 0], key=lambda s: s[0], default=(0.0, ""))
        facts.append((best, start, flags, veiled))
    out = [np.log1p(len(tokens))]
    for k in (0, 1):
        hits = [f[k] for f in facts if f[k][0] > 0]
        out += [sum(h[0] for h in hits) / n, len(hits) / n, np.log1p(len(hits)), len({h[1] for h in hits}), max([h[0] for h in hits], default=0.0)]
    second = [k for k, f in enumerate(facts) if f[2] & 1]
    hits = [k for k, f in enumerate(facts) if f[0][0] > 0]
    letters = [k for k, f in enumerate(facts) if f[2] & 16]
    spaced, k = 0, 0
    while k < len(letters):
        stop = k
        while stop + 1 < len(letters) and letters[stop + 1] == letters[stop] + 1:
            stop += 1
        spaced += stop - k + 1 > 3 and "".join(tokens[x] for x in letters[k : stop + 1]).lower() in weight
        k = stop + 1
    data = text.encode()
    count = lambda kind: sum(b in kind for b in data)
    out += [
        len(second) / n,
        sum(any(abs(h - s) <= 5 for s in second) for h in hits) / n,
        (sum(f[3] for f in facts) + spaced) / n,
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / len(data),
        sum(bool(f[2] & 2) for f in facts) / n,
        sum(bool(f[2] & 2) and f[0][0] > 0 for f in facts) / n,
        count(b"!") / n,
        count(b"?") / n,
        len(re.findall(r"[!?]{2,}", text)) / n,
        count(b"#*$%&|<>@") / n,
        count(b"0123456789") / n,
        sum(bool(f[2] & 4) for f in facts) / n,
        sum(bool(f[2] & 8) for f in facts) / n,
        (len(text) - len(tokens)) / n,
    ]
    return [float(x) for x in out]


LONG_A, LONG_B = "q" * 40 + "alpha", "q" * 40 + "omega"


def test_features_equal_a_plain_version():
    rng = random.Random(13)
    weight = {"idiot": 2.5, "dummkopf": 2.5, "tonto": 1.5, "idio*": 2.0, "dumm*": 1.25, toxicity.kept_whole(LONG_A): 3.0}
    pool = ["idiot", "IDIOT", "id1ot!", "i-d-i-o-t", "idioot", "idiooot", "you", "du", "ti", "Dummkopf,", "dummheit", "tonto", "i", "d", "o", "t", "hello", "WORLD", "a$$", "42", "??!", "été", LONG_A, LONG_B, "x" * 300 + "1d", "ok."]
    bodies = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))).replace("ok. ", "ok.\n") for _ in range(300)] + [None, "", "i d i o t", "foo"]
    got = toxicity.Lexicon(weight).features(bodies)
    want = np.array([plain_features(t, weight) for t in bodies])
    assert np.abs(got - want).max() < 1e-9, [toxicity.FEATURES[k] for k in np.flatnonzero(np.abs(got - want).max(axis=0) > 1e-9)]


def test_words_of_equal_weight_are_two_kinds():
    lexicon = toxicity.Lexicon({"foo": 1.5, "bar": 1.5})
    kinds = lexicon.features(["foo bar", "foo foo"])[:, toxicity.FEATURES.index("word_kinds")]
    assert kinds.tolist() == [2, 1]


def test_long_words_with_one_beginning_are_two_terms():
    a, b = ("z" * 40 + x * 10 for x in "ab")
    assert toxicity.terms(a) - toxicity.terms(b) and toxicity.words_of(a)[0] != toxicity.words_of(b)[0]
    hidden = toxicity.words_of("x" * 250 + "1diot")[1]
    assert toxicity.kept_whole("x" * 250 + "idiot") in hidden


def test_trees_take_the_best_cut_of_all(monkeypatch):
    """Each inner node of each tree against a search over all cuts of all features; leaves against plain sums."""
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(15)
    x = rng.integers(0, 8, (600, 5)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 5) ^ (rng.random(600) < 0.1)).astype(float)
    model = toxicity.Trees().fit(x, y)
    weight = np.where(y > 0, 300 / y.sum(), 300 / (600 - y.sum()))
    score = np.full(600, model.base)
    worth = lambda s, g, h: g[s].sum() ** 2 / (h[s].sum() + 1)
    for tree, leaves in model.trees:
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(600, int)
        for feature, limit in tree:
            for k in range(len(feature)):
                own = node == k
                cuts = [(own & (x[:, f] <= v), own & (x[:, f] > v)) for f in range(5) for v in range(7)]
                gains = [worth(a, g, h) + worth(b, g, h) for a, b in cuts if min(a.sum(), b.sum()) >= toxicity.LEAST_LEAF]
                if gains:
                    a = own & (x[:, feature[k]] <= limit[k])
                    assert abs(worth(a, g, h) + worth(own & ~a, g, h) - max(gains)) < 1e-9
            node = 2 * node + (x[np.arange(600), feature[node]] > limit[node])
        want = np.array([toxicity.RATE * g[node == k].sum() / (h[node == k].sum() + 1) for k in range(len(leaves))])
        assert np.abs(want - leaves).max() < 1e-9
        score += leaves[node]
    assert np.abs(model.raw(x) - score).max() < 1e-9


def test_lexicons_keep_every_term_of_enough_weight(spark):
    rng = random.Random(14)
    rows = [(k, " ".join([f"bad{rng.randrange(40)}"] * (k % 3 == 0) + [f"w{rng.randrange(60)}" for _ in range(8)]), int(k % 3 == 0), k % 5) for k in range(400)]
    some = spark.createDataFrame([r for r in rows if r[3]], "doc_id bigint, text string, toxic int, fold int")
    totals = {k: (sum(r[3] == k and r[2] for r in rows), sum(r[3] == k and not r[2] for r in rows)) for k in toxicity.FOLDS}
    got = toxicity.lexicons(toxicity._counts(some, totals), totals)
    for fold in (0, *toxicity.FOLDS):
        use = [r for r in rows if r[3] and r[3] != fold]
        n_t, n_c = sum(r[2] for r in use), sum(not r[2] for r in use)
        every = set().union(*(toxicity.terms(r[1]) for r in use))
        want = {}
        for term in every:
            t, c = (sum(term in toxicity.terms(r[1]) for r in use if r[2] == s) for s in (1, 0))
            w = float(toxicity.weights(np.array([t]), np.array([c]), n_t, n_c)[0])
            if t >= toxicity.LEAST_TEXTS and w >= toxicity.LEAST_WEIGHT:
                want[term] = w
        assert got[fold].weight.keys() == want.keys() and want
        assert all(abs(got[fold].weight[k] - v) < 1e-12 for k, v in want.items())
