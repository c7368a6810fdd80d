from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from fluxloom.llm import mixing, quality, secrets, sentences, simhash, tokens, toxicity
from fluxloom.llm.text import words_of
from fluxloom.llm.wavelet import WaveletShard, build
from fluxloom.llm.wordpieces import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def by_key(rows):
    return sorted(rows, key=repr)


# ---------------------------------------------------------------- words, quality


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_words_are_those_of_the_pattern(hard):
    for row in hard.select("text", words_of(hard["text"]).alias("w")).collect():
        assert row["w"] == WORD.findall(row["text"] or "")


def test_quality_counts_equal_brute_force(hard):
    judged = quality.judge(hard, ["doc_id", "text"]).collect()
    assert len(judged) == hard.count()
    for r in judged:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_counts(r["row"]["text"])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_plain_and_drops_odd_documents(spark):
    rng = random.Random(1)
    plain = [(i, " ".join(rng.choice("river stone house light".split()) + str(rng.randint(0, 10**6)) for _ in range(80)), "en", "a", 0) for i in range(40)]
    odd = [(100, " ".join(w + "***" for w in plain[0][1].split()), "en", "a", 0), (101, plain[1][1].upper(), "en", "a", 0)]
    docs = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["row"]["doc_id"] for r in quality.judge(docs, ["doc_id"]).where("kept").collect()}
    assert kept == set(range(40))


def test_quality_sketch_is_merged_exactly(hard):
    measured = quality.measure(hard, ["doc_id"])
    one = quality.merged(quality.sketches(measured, ["repeat_share"]), 10)
    many = quality.merged(quality.sketches(measured.repartition(7), ["repeat_share"]), 10)
    assert by_key(map(tuple, one.collect())) == by_key(map(tuple, many.collect()))


def test_quality_of_nothing(nothing):
    assert quality.judge(nothing, nothing.columns).count() == 0


# ---------------------------------------------------------------- near-duplicates


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_classes(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a != b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprints_and_classes_equal_brute_force(hard):
    rows = simhash.classified(hard, ["doc_id", "text"]).withColumn("hex", simhash.hexadecimal("print")).collect()
    assert len(rows) == hard.count()
    prints = {(r["row"]["doc_id"], r["row"]["text"]): brute_print(r["row"]["text"]) for r in rows}
    root = brute_classes(set(prints.values()))
    members = defaultdict(list)
    for (doc_id, _), p in prints.items():
        members[root[p]].append(doc_id)
    for r in rows:
        p = prints[r["row"]["doc_id"], r["row"]["text"]]
        assert r["hex"] == f"{p:016x}"
        known = [x for x in members[root[p]] if x is not None]
        assert r["component_id"] == (min(known) if known else None)


def test_keys_meet_for_every_pair_within_three_bits():
    rng = random.Random(3)
    one = np.array([rng.getrandbits(64) for _ in range(800)], np.uint64)
    other = one.copy()
    for i in range(len(other)):
        for bit in rng.sample(range(64), i % 4):
            other[i] ^= np.uint64(1 << bit)
    near, wide = defaultdict(set), defaultdict(set)
    for keys, held, only in ((near, one, True), (wide, other, False)):
        for p, k in zip(*(x.tolist() for x in simhash.keys_of(held.astype(np.int64), only))):
            keys[p].add(k)
    assert all(near[a] & wide[b] for a, b in zip(one.astype(np.int64).tolist(), other.astype(np.int64).tolist()))


def test_every_word_has_one_or_six_codewords():
    _, used = simhash.error_patterns()
    assert set(used.tolist()) == {1, 6}


def test_components_of_a_chain_a_star_and_a_ring(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    ring = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges = spark.createDataFrame([(min(e), max(e)) for e in chain + star + ring], "low long, high long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {n: 1 if n <= 40 else 100 if n < 200 else 200 for e in chain + star + ring for n in e}


def test_one_of_each_class_stays(hard):
    left = simhash.one_of_each(hard, hard.columns)
    assert left.columns == hard.columns
    ids = [r["doc_id"] for r in left.collect()]
    root = brute_classes({brute_print(r["text"]) for r in hard.collect()})
    assert len(ids) == len(set(root.values())) and ids.count(5) == 1 and 100 not in ids


def test_no_documents_no_classes(nothing):
    assert simhash.classified(nothing, ["doc_id"]).count() == 0 and simhash.one_of_each(nothing, nothing.columns).count() == 0


# ---------------------------------------------------------------- secrets

KEY = "ghp" + "Zk3v9QpL2xT7mN4bW8sY"
TEXTS = [
    f'set password = "abc123" and TOKEN:{KEY} end', "api_key=12345 short", "AKIA" + "A1B2C3D4E5F6G7H8 and AKIA1",
    "hash 0123456789abcdef0123456789abcdef done", "secret: token: abcdefgh", "no secrets, only paßword=abcdefg", "", None,
    "ſecret=abcdefgh toKen=abcdefgh", "password=x" + "9" * 50_000,
]


def test_base_spans_follow_the_patterns():
    assert secrets.joined(secrets.base_spans(TEXTS[0])) == f"assign:4:22,assign:28:{34 + len(KEY)}"
    assert secrets.base_spans(TEXTS[1]) == []
    assert [s[2] for s in secrets.base_spans(TEXTS[2])] == ["access"]
    assert secrets.joined(secrets.base_spans(TEXTS[3])) == "hex:5:37"
    assert secrets.base_spans(TEXTS[4]) == []  # the first match ends at the second keyword and is too short
    assert secrets.base_spans("ſecret=abcdefgh") == [] and len(secrets.base_spans("x toKen=abcdefgh")) == 1
    assert secrets.base_spans(TEXTS[9]) == [(0, len(TEXTS[9]), "assign"), (10, len(TEXTS[9]), "hex")]


def test_candidates_touch_no_base_span():
    text = f"token={KEY} and {KEY}"
    base = secrets.base_spans(text)
    assert [text[a:z] for a, z in secrets.candidates(text, base)] == [KEY]


def findings(n, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = []
    for _ in range(n):
        rows.append((1, "the key is ", "".join(rng.choice(letters) for _ in range(rng.randint(20, 40))), " and so on"))
        rows.append((0, "mail to ", f"mail{rng.randint(1, 999)}.example.com", " and so on"))
        rows.append((0, "card ", str(rng.randint(10**15, 10**16)), " of mine"))
    return rows


def test_network_finds_held_out_secrets_and_is_repeatable():
    network = secrets.train(findings(150, 1))
    fresh = findings(60, 2)
    p = network.probability([r[1:] for r in fresh])
    y = np.array([r[0] for r in fresh])
    assert (p[y == 1] >= network.threshold).mean() >= 0.95 and (p[y == 0] >= network.threshold).mean() <= 0.02
    again = secrets.train(findings(150, 1))
    assert np.array_equal(again.probability([r[1:] for r in fresh]), p)
    assert secrets.train([r for r in findings(20, 1) if r[0]]) is None


def test_gradients_equal_differences():
    network = secrets._fresh(np.random.default_rng(0))
    coded = [secrets._codes(r[1:]) for r in findings(2, 4)]
    length = max(len(c) for c, _ in coded)
    codes, inside = np.full((len(coded), length), secrets.SYMBOLS - 1), np.zeros((len(coded), length))
    for i, (c, m) in enumerate(coded):
        codes[i, : len(c)], inside[i, : len(m)] = c, m
    labels = np.array([1.0, 0, 0, 1, 0, 0])

    def loss():
        z = network._forward(codes, inside)[0]
        return np.mean(np.logaddexp(0, z) - labels * z)

    for name, g in network.gradients(codes, inside, labels).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape) if g.ndim else ()
        held = network.weights[name].copy()
        sides = []
        for step in (1e-5, -1e-5):
            network.weights[name] = held.copy()
            network.weights[name][at] += step
            sides.append(loss())
        network.weights[name] = held
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(float(g[at]), rel=1e-3, abs=1e-8)


def test_scan_counts_and_digest(spark):
    import hashlib

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = secrets.scan(docs, ["doc_id"], None).orderBy("row.doc_id").collect()
    assert [(r["n_assign"], r["n_access"], r["n_hex"]) for r in rows] == [
        (2, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 1)]
    for r, text in zip(rows, TEXTS):
        spans = secrets.joined(secrets.base_spans(text or ""))
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and r["spans"] == spans


def test_masking():
    assert secrets.mask("a token=abcdef b", [(2, 14, "assign"), (8, 14, "hex")]) == "a [secret] b"
    assert secrets.mask("abcdef", [(0, 4, "assign"), (2, 6, "hex")]) == "[secret]"
    assert secrets.mask("abc", []) == "abc"


def test_secrets_of_hard_and_no_documents(hard, nothing):
    network = secrets.fit(hard)
    assert secrets.masked(hard, network).select("text").collect() == hard.select("text").collect()
    assert secrets.scan(nothing, ["doc_id"], secrets.fit(nothing)).count() == 0
    carried = secrets.scan(hard, ["doc_id", "spans"], network).select("row.spans").distinct().collect()
    assert [r["spans"] for r in carried] == ["spans"]


# ---------------------------------------------------------------- token shards


def test_wavelet_answers_equal_the_list():
    rng = np.random.default_rng(0)
    held = rng.zipf(1.4, 5000).astype(np.int64) % 40_000
    shard = WaveletShard(build(held, [4, None], np.array([2000, 3000]), block=512))
    assert np.array_equal(shard.tokens(), held)
    assert shard.documents()[0] == [4, None] and shard.documents()[1].tolist() == [2000, 3000]
    for i in rng.integers(0, 5000, 40).tolist():
        assert shard.access(i) == held[i]
        a, z = sorted(rng.integers(0, 5001, 2).tolist())
        assert shard.count(int(held[i]), a, z) == int((held[a:z] == held[i]).sum())
        places = np.flatnonzero(held == held[i])
        k = int(rng.integers(len(places)))
        assert shard.locate(int(held[i]), k) == places[k]
    assert shard.count(1 << 20) == 0
    with pytest.raises(IndexError):
        shard.locate(1 << 20, 0)
    with pytest.raises(IndexError):
        shard.access(5000)


def test_empty_shard():
    shard = WaveletShard(build(np.zeros(0, np.uint16), [], np.zeros(0, np.int64)))
    assert shard.tokens().tolist() == [] and shard.documents()[0] == [] and shard.count(3) == 0


ODD = ["", " ", "a\x0bb\x0cc", "It's we're THE!! x", "é é ÀÉ", "a b c", "日本語 12345 ½²", "  lead  and   trail  ", "a\n\nb\n", "▁x ▁",
       "\x00\x01 𝄞", "ΣΑΣ ς İ", "don't 'tis o'clock'll", "ǅ ﬁ ª º µ × ÷", "\n", "a\r\nb\tc", "<|endoftext|> x<|endoftext|>y", "foo,bar;baz--", "x" * 5000]


def test_word_ids_equal_the_library():
    code = WordEncoder(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    for _ in range(2):
        got = [np.frombuffer(x, code.kind).tolist() for x in code.encode([t.encode() for t in ODD])]
        assert got == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_shards_read_back(hard, size):
    library = Tokenizer.from_file(VOCABULARY)
    rows = hard.select("doc_id", "text").collect()
    shards = tokens.shards_of(hard, VOCABULARY, shard_tokens=size).cache()
    got = tokens.per_document(shards).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    place = 0
    for r in got:
        assert r["start"] == place
        place += r["n_tokens"]
    def digest(text):
        coded = library.encode(text or "", add_special_tokens=False).ids + [2]
        return len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())
    assert by_key((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == by_key((r["doc_id"], *digest(r["text"])) for r in rows)


def test_no_documents_no_shards(nothing):
    assert tokens.per_document(tokens.shards_of(nothing, VOCABULARY)).count() == 0


# ---------------------------------------------------------------- SentencePiece


def test_pieces_equal_the_original_and_read_back():
    code = sentences.Codec(PIECES)
    coded = code.encode(ODD)
    assert [np.frombuffer(x, code.kind).tolist() for x, _ in coded] == code.original.encode(ODD)
    assert all(same for _, same in coded) and code.by_unit
    assert [code.decode(x) for x, _ in coded] == [t.replace("▁", " ") for t in ODD]
    assert [e.ids for e in code.whole.encode_batch(ODD, add_special_tokens=False)] == code.original.encode(ODD)


def test_a_unit_that_differs_is_reported():
    code = sentences.Codec(PIECES)
    true = code._ids
    code._ids = lambda parts: [x + x if p == "▁wrong" else x for p, x in zip(parts, true(parts))]
    coded = code.encode(["right here", "all wrong"])
    assert [same for _, same in coded] == [True, False]
    assert [np.frombuffer(raw, code.kind).tolist() for raw, _ in coded] == code.original.encode(["right here", "all wrong"])


def unigram_file() -> bytes:
    def field(number, kind, raw):
        return bytes([number << 3 | kind]) + raw
    import struct
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("b", -2.5, 1), ("ab", -1.0, 1), ("▁ab", -1.2, 1), ("a", -3.0, 1)]
    out = b""
    for piece, score, kind in pieces:
        raw = piece.encode()
        inner = field(1, 2, bytes([len(raw)]) + raw) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        out += field(1, 2, bytes([len(inner)]) + inner)
    trainer = field(3, 0, b"\x01")
    return out + field(2, 2, bytes([len(trainer)]) + trainer)


def test_unigram_scores_are_rebuilt():
    model = sentences.read_model(unigram_file())
    assert model.kind == sentences.UNIGRAM and model.pieces[2] == ("▁a", -1.5, 1) and model.remove_extra_spaces
    assert sentences.rebuilt(model).encode("  ab  aab ").tokens == ["▁ab", "▁a", "ab"]


def test_encoded_documents(hard, nothing):
    rows = sentences.encoded(hard, ["doc_id", "text"], PIECES, ids="ids").collect()
    assert len(rows) == hard.count()
    code = sentences.Codec(PIECES)
    for r in rows:
        ids = code.original.encode(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["parity"] and r["round_trip"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sentences.encoded(nothing, ["doc_id"], PIECES).count() == 0


def test_encoded_documents_with_a_clashing_column(spark):
    docs = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, n_tokens string")
    row = sentences.encoded(docs, ["doc_id", "n_tokens"], PIECES, prefix="made_").first()
    assert (row["n_tokens"], row["made_n_tokens"], row["made_parity"]) == ("mine", 2, True)


# ---------------------------------------------------------------- mixing


def test_quotas_over_shelves_equal_running_sums(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", 7, int(b)) for b in rng.integers(0, mixing.BUCKETS, 3000)] + [
        (None, 7, int(b)) for b in rng.integers(0, 200, 50)] + [("cold", 9, 4095), ("unasked", 7, 1)]
    plan = [("hot", 7, 1717), (None, 7, 20), ("cold", 9, 5)]
    units = spark.createDataFrame(rows, "g_source string, unit_words long, bucket long")
    got = mixing.quotas(units, spark.createDataFrame(plan, "g_source string, unit_words long, more long")).collect()
    expected = {}
    for source, words, more in plan:
        left = more
        for bucket in sorted({b for s, w, b in rows if (s, w) == (source, words)}):
            if left > 0:
                expected[source, words, bucket] = left
            left -= rows.count((source, words, bucket))
    assert {(r["g_source"], r["unit_words"], r["bucket"]): r["left"] for r in got} == expected and len(got) == len(expected)


def test_fill_reaches_what_brute_force_reaches():
    rng = random.Random(2)
    for _ in range(300):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        taken = mixing.fill(lengths, counts, budget)
        total = sum(a * b for a, b in zip(lengths, taken))
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        assert best - max(1, budget // 1000) <= total <= best


def test_fill_of_a_large_budget_is_near():
    rng = random.Random(4)
    lengths = rng.sample(range(1, 20_000), 900)
    counts = [rng.randint(1, 40) for _ in lengths]
    budget = sum(a * b for a, b in zip(lengths, counts)) * 2 // 3
    assert budget - sum(a * b for a, b in zip(lengths, mixing.fill(lengths, counts, budget, dp_budget=5000))) in (0, 1)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, held = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        level = (total - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return held | {s: weight[s] * level for s in free}
        held |= {s: 2.0 * sizes[s] for s in over}


def test_targets_equal_brute_force(spark):
    rng = random.Random(5)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 200, 5000]) for i in range(n)} | {None: 70}
        frame = spark.createDataFrame(list(sizes.items()), "g_source string, source_words long")
        got = {r["g_source"]: r["target"] for r in mixing.source_targets(frame, mixing.Mix()).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix_is_near_its_targets_and_repeatable(hard):
    rows = mixing.mixed(hard, ["doc_id", "text", "source"]).collect()
    assert len(rows) == hard.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["words"] == len(WORD.findall(r["row"]["text"] or "")) and 0 <= r["copies"] <= 2
        sizes[r["row"]["source"]] += r["words"]
        taken[r["row"]["source"]] += r["words"] * r["copies"]
    targets = brute_targets(dict(sizes))
    for r in rows:
        assert r["source_words"] == sizes[r["row"]["source"]] and r["target"] == pytest.approx(targets[r["row"]["source"]])
    for source, target in targets.items():
        sums = 1
        for r in rows:
            if r["row"]["source"] == source:
                sums |= sums << r["words"] | sums << 2 * r["words"]
        best = (sums & ((1 << (round(target) + 1)) - 1)).bit_length() - 1
        assert best - max(1, target / 1000) <= taken[source] <= best
    again = mixing.mixed(hard.repartition(5), ["doc_id", "text", "source"]).collect()
    key = lambda rs: sorted(repr((r["row"], r["copies"])) for r in rs)
    assert key(rows) == key(again)


def test_the_mix_itself_and_no_mix(hard, nothing):
    got = mixing.materialised(hard, hard.columns)
    assert got.columns == hard.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in got.collect())
    assert words == sum(r["words"] * r["copies"] for r in mixing.mixed(hard, ["doc_id"]).collect())
    assert mixing.mixed(nothing, ["doc_id"]).count() == 0


# ---------------------------------------------------------------- toxicity


def labelled(spark, n=400):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [rng.choice("river stone house light garden winter music paper".split()) + str(rng.randint(0, 40)) for _ in range(60)]
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["nastyfool", "nastyword", "wretch"])
        docs.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, 1, int(bad)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (None, "nastyfool", "en", "a", 0), docs[10], docs[11]]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxic_documents_score_high(spark):
    docs, labels = labelled(spark)
    rows, index = toxicity.fit(docs, labels, ["doc_id"])
    got = toxicity.scored(rows, index).withColumn("held", toxicity.is_held_out(rows["id"])).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 4 == 2)
        if r["id"] is not None:
            assert r["predicted"] == int(r["id"] < 1000 and r["id"] % 5 == 0)


def test_search_equals_comparing_all():
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 5, 40)
    bare = toxicity.Index.build([], idf, [], np.zeros(0), np.zeros(0))
    terms = [sorted(rng.choice(40, int(rng.integers(1, 6)), replace=False).tolist()) for _ in range(500)]
    vectors = [bare.vector(t, rng.integers(1, 5, len(t)).tolist()) for t in terms]
    index = toxicity.Index.build(vectors, idf, list(range(500)), rng.integers(0, 2, 500).astype(float), np.ones(500))
    dense = np.zeros((500, 40))
    for i, (t, w, _) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 500, 7):
        t, w, _ = vectors[i]
        cosine = dense @ dense[i]
        cosine[i] = 0
        places, got = index.nearest(t, w, k=15, leave=i)
        want = np.sort(cosine[cosine > 1e-12])[::-1][:15]
        assert np.allclose(got, want) and np.allclose(cosine[places], got)


def test_no_toxic_labels_give_one_score(spark, hard, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, index = toxicity.fit(hard, none, ["doc_id"])
    assert {r["score"] for r in toxicity.scored(rows, index).collect()} == {1 / 20}
    rows, index = toxicity.fit(nothing, none, ["doc_id"])
    assert toxicity.scored(rows, index).count() == 0
