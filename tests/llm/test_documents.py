import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import bpe_automaton, common, exact_dedup, flac, language_id, mixing, near_dedup, queries, token_files
from sieveline.llm.words import BatchEncoder

from . import helpers


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    return folder, helpers.documents(spark, folder)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_automaton.default_tokenizer())


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op1_warc", "op3_chat_format", "op9_html_main_text")])
def test_empty_tables(spark, tmp_path, name):
    helpers.empty_documents(spark, str(tmp_path))
    assert run(spark, str(tmp_path), name) == []


def test_op5(spark, small, library):
    folder, rows = small
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, run(spark, folder, "op5_bpe_automaton"))) == want


def test_op5_encode_and_decode(spark, small, library):
    folder, rows = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = bpe_automaton.encode(docs, bpe_automaton.default_tokenizer())
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((d, tuple(library.encode(t or "").ids)) for d, t, *_ in rows)
    back = bpe_automaton.decode(ids, bpe_automaton.default_tokenizer())
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t, *_ in rows)


def test_automaton_is_the_explicit_one_and_encodes_as_merging_does():
    import random

    r = random.Random(5)
    for _ in range(150):
        labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        for _ in range(r.randint(1, 12)):
            u, v = r.choice(list(labels)), r.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                merges.append((u, v, len(labels)))
                labels[len(labels)] = labels[u] + labels[v]
        made, after = bpe_automaton.Automaton(labels, merges, {}), bpe_automaton.explicit_automaton([0, 1, 2], merges)
        assert all(made.arc(x, y) == (y in after[x]) for x in labels for y in labels if after[x])
        ranks = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
        for _ in range(30):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            ids = [c - 97 for c in word]
            while found := [(ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]:
                k = min(found)[1]
                ids[k : k + 2] = [ranks[ids[k], ids[k + 1]][1]]
            assert made.encode_word(word) == ids


def test_batches_agree_with_the_library(library):
    special = {"<|endoftext|>": 50256}

    def ids_of(words):
        ids = [x.ids for x in library.encode_batch(words, add_special_tokens=False)]
        return np.array([x for y in ids for x in y], np.int32), np.array([len(x) for x in ids], np.int64)

    encoder = BatchEncoder(ids_of, special, bits=4, step=16)  # a table that overflows, and texts in pieces
    texts = ["", " ", "a  b\n\n c", "it's 'tis we'll\t x", "<|endoftext|>", "x<|endoftext|>y '", "日本語 １２３ ½   x", "end   ", "\r\n\r\nhi  ", "é'S 's", "'", "　  a"] * 3
    for _ in range(2):
        ids, n = encoder.encode(texts)
        stops = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(stops, n)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_words_that_share_a_hash_keep_their_own_ids(spark, tmp_path, library):
    """The Thue-Morse word and its complement have equal polynomial hashes mod 2**64 from 1024 letters on."""
    texts = [t for n in (128, 1024, 2048, 4096) for t in (thue_morse(n), thue_morse(n).translate({97: "b", 98: "a"}))]
    for encoder in (bpe_automaton.batch_encoder(bpe_automaton.default_tokenizer()), token_files.library_encoder(bpe_automaton.default_tokenizer())):
        for some in (texts, texts[::-1], [" ".join(texts)], texts[2:3], texts[3:4]):
            ids, n = encoder.encode(some)
            stops = np.cumsum(n)
            assert [ids[e - k : e].tolist() for e, k in zip(stops, n)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_all_hashes_equal(library, monkeypatch):
    from sieveline.llm import words

    monkeypatch.setattr(words, "hashes", lambda cp, starts, length: np.full(len(starts), 1 << 60, np.uint64))
    automaton = bpe_automaton.load(bpe_automaton.default_tokenizer())
    encoder = BatchEncoder(automaton.encode_words, automaton.special)
    for text in ("one two one three tow two", "six two one", "two"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_and_words(library):
    import random

    r = random.Random(2)
    automaton = bpe_automaton.load(bpe_automaton.default_tokenizer())
    encoder = BatchEncoder(automaton.encode_words, automaton.special, step=1000)
    text = "".join(r.choice(["word ", "été", "  ", "\n\n ", "日本語", "x" * r.randrange(90), " 12345", "'s ", "aAbB" * r.randrange(600), " "]) for _ in range(3000))
    ids, n = encoder.encode([text, "", text[::-1]])
    assert ids[: n[0]].tolist() == library.encode(text, add_special_tokens=False).ids and ids[n[0] :].tolist() == library.encode(text[::-1], add_special_tokens=False).ids
    word = "".join(r.choice("abcdeé") for _ in range(5000))
    assert automaton.encode_long(word.encode(), window=100) == library.encode(word, add_special_tokens=False).ids


def test_op10(spark, small, library):
    folder, rows = small
    got = sorted(map(tuple, run(spark, folder, "op10_token_files")), key=lambda r: r[1])
    start, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "").ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_huffman_codes():
    rng = np.random.default_rng(3)
    counts = (rng.pareto(0.4, 3000) * 3).astype(np.int64)
    for most in (12, 14, 20):
        lengths = token_files.code_lengths(counts, most)
        used = lengths[lengths > 0]
        assert used.max() <= most and (lengths > 0).sum() == (counts > 0).sum() and (2.0**-used).sum() <= 1 + 1e-12
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((token_files.code_lengths(counts, 60) * counts).sum()) == cost
    coder = token_files.Coder(token_files.code_lengths(counts))
    ids = [rng.choice(np.flatnonzero(counts), n) for n in (1, 512, 513, 5000)]
    packed = [coder.encode(x) for x in ids]
    back = coder.decode([np.frombuffer(p, np.uint8) for p, _ in packed], [c for _, c in packed], [len(x) for x in ids])
    assert all(np.array_equal(a, b) for a, b in zip(ids, back))
    one = token_files.Coder(token_files.code_lengths(np.array([0, 7])))
    payload, at = one.encode(np.ones(9, np.int64))
    assert one.decode([np.frombuffer(payload, np.uint8)], [at], [9])[0].tolist() == [1] * 9


def test_op8(spark, small):
    folder, rows = small
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[low(text)].append(doc_id)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = groups[low(text)]
        keep = max((i for i in ids if i is not None), default=None)
        want[doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(low(text).encode()).hexdigest()] += 1
    assert Counter(map(tuple, run(spark, folder, "op8_exact_dedup"))) == want


def test_chunks_follow_content_and_collisions_fall_back(spark, monkeypatch):
    body = bytes(np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8))
    cut = lambda b: exact_dedup.chunk_ends(exact_dedup.cut_points(np.frombuffer(b, np.uint8), 4096), 0, len(b), 1024, 32768)
    chunks = lambda b: {b[x:y] for x, y in zip([0, *cut(b)], cut(b))}
    assert b"".join(body[x:y] for x, y in zip([0, *cut(body)], cut(body))) == body
    assert len(chunks(body) & chunks(b"inserted " + body)) > len(chunks(body)) * 0.8
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "colliding", lambda staged: True)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.groups(docs).collect()} == {(1, 3), (2, 2), (3, 3)}


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def check_mix(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += size(text)
    target = brute_targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = Counter()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], abs_tol=1e-6) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    return sizes, target, taken


def test_op6(spark, small):
    folder, rows = small
    got = run(spark, folder, "op6_mix_sources")
    check_mix(rows, got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, run(spark, folder, "op6_mix_sources")))


def test_op6_comes_near_its_targets_and_gives_documents(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20 + k % 70)), "en", None if k % 11 == 0 else f"s{k % 7 % 5}", 1) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes, target, taken = check_mix(rows, mixing.Mix(docs).digest().collect())
    assert all(abs(taken[s] - target[s]) <= 130 for s in sizes)
    out = mixing.mixed_documents(docs).collect()
    words = Counter()
    for r in out:
        original = rows[r.doc_id][1].split()
        part = r.text.split()
        assert any(original[k : k + len(part)] == part for k in range(len(original))) or set(part) <= set(original)
        words[r.source] += len(part)
    assert words == Counter({s: n for s, n in taken.items() if n})


def test_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(1))).collect()]
        assert sorted(got) == list(range(n)) and (n < 1000 or got != sorted(got))


def test_op6_draws_source_counts_for_each_shard(spark):
    """Slots of each source add up to the plan; counts of shards are spread as draws from one urn are, not dealt evenly."""
    rows = [(f"s{k}", n, 1, float(t), k) for k, (n, t) in enumerate(((400_000, 500_000), (300_000, 200_000), (100_000, 100_000), (0, 0)))]
    targets = spark.createDataFrame(rows, "source string, source_size long, n_rows long, target double, rank int")
    slots = mixing.slot_table(targets, block_tokens=10, shard_blocks=400).collect()
    n, total = len(slots), Counter(r.source for r in slots)
    assert total == {"s0": 50_000, "s1": 20_000, "s2": 10_000}
    assert {r.shard for r in slots} == set(range(n // 400)) and set(Counter(r.shard for r in slots).values()) == {400}
    assert len({(r.source, r.slot) for r in slots}) == n and set(Counter((r.source, r.epoch, r.block) for r in slots).values()) == {1}
    of = Counter((r.source, r.shard) for r in slots)
    for source, count in total.items():
        p = count / n
        spread = np.var([of[source, k] for k in range(n // 400)])
        assert 0.6 < spread / (400 * p * (1 - p) * (n - 400) / (n - 1)) < 1.5  # 200 shards


def test_op6_stands_many_sources(spark):
    rows = [(k, f"a b c d e {k}", f"s{k % 100:03d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block_tokens=4)
    got = mix.digest().collect()
    assert len(got) == 300 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) < 300


def test_op7(spark, small):
    folder, rows = small
    want = Counter()
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        body_padded = body + b"\xff" * (-len(body) % 576 if body else 576)
        want[doc_id, len(body), len(body_padded), hashlib.sha256(body_padded).hexdigest(), zlib.crc32(body_padded[-32:])] += 1
    got = run(spark, folder, "op7_flac_media")
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_flac_streams():
    rng = np.random.default_rng(2)
    wave = (128 + 100 * np.sin(np.arange(5000) / 20)).astype(np.uint8)
    payloads = [np.zeros(0, np.uint8), np.full(3000, 255, np.uint8), rng.integers(0, 256, 5000).astype(np.uint8), wave, np.where(np.arange(1500) % 300 == 0, 255, 0).astype(np.uint8), np.frombuffer(b"x", np.uint8)]
    streams = flac.encode_streams(payloads)
    for p, d in zip(payloads, flac.decode_streams(streams)):
        assert np.array_equal(p.astype(int) - 128, d)
    assert len(streams[1]) < 300 and len(streams[3]) < 2000
    offset, block = flac.seek(streams[3], 2999)
    assert offset <= 2999 < offset + len(block) and np.array_equal(block, wave[offset : offset + len(block)].astype(int) - 128)
    for where in (-30, -1, len(streams[3]) // 2):
        damaged = bytearray(streams[3])
        damaged[where] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(damaged)])


def test_flac_reads_partitions_wasted_bits_and_escapes():
    """A frame written bit by bit: fixed order 1, two partitions, the second escaped; two wasted bits."""
    samples = [4 * x for x in (1, 3, 2, -5, 7, 0, -1, 2)]
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    bits += put(0, 1) + put(9, 6) + "1" + "01"  # fixed order 1, two wasted bits
    x = [s // 4 for s in samples]
    bits += put(x[0], 6)
    residual = [b - a for a, b in zip(x, x[1:])]
    bits += "00" + put(1, 4)
    bits += put(2, 4)
    for r in residual[:3]:
        u = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (u >> 2) + "1" + put(u & 3, 2)
    bits += put(15, 4) + put(6, 5) + "".join(put(r, 6) for r in residual[3:])
    bits += "0" * (-len(bits) % 8)
    head = flac._header(0, 7, (7).to_bytes(2, "big"))
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    data = np.frombuffer(frame, np.uint8)
    crc = int(flac.crc16s(data, np.array([0]), np.array([len(frame)]))[0])
    frame += crc.to_bytes(2, "big")
    md5 = hashlib.md5(np.array(samples, "i1").tobytes()).digest()
    stream = b"fLaC\x80" + (34).to_bytes(3, "big") + flac._stream_info(8, np.array([len(frame)]), md5) + frame
    assert flac.decode_streams([stream])[0].tolist() == samples


def test_flac_blocks(spark, small):
    folder, rows = small
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 5")
    blocks = flac.pcm_blocks(flac.encode_media(docs)).orderBy("sample_offset").collect()
    data = b"".join(bytes(b.pcm) for b in blocks)
    text = helpers.LONG % (("x",) * 4000)
    assert bytes((x + 128) & 255 for x in data[: len(text)]).decode() == text and [b.sample_offset for b in blocks[:3]] == [0, 576, 1152]


def test_op2(spark, small):
    folder, rows = small
    got = run(spark, folder, "op2_language_id")
    known = {r[2] for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        unreadable = r.doc_id in (3, 4, 7)
        assert (r.lang_pred == "und") == unreadable and (unreadable or r.lang_pred in known)


def test_op2_learns_and_rejects(spark):
    import random

    r = random.Random(1)
    words = {"en": "the of and that which with house under water people".split(), "de": "der und nicht auf haus unter wasser leute schön über".split()}
    rows = [(k, " ".join(r.choices(words[lang], k=30)), lang) for k in range(400) for lang in [("en", "de")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, per_language=50, clusters=2)
    assert model.languages == ["de", "de", "en", "en"]
    found = language_id.predict(docs, model).collect()
    assert all(x.lang == x.lang_pred and not x.rejected for x in found)
    other = language_id.predict(spark.createDataFrame([(1, "это совсем другой язык и другие буквы"), (2, "ΩΩ ψψ φφ")], "doc_id long, text string"), model).collect()
    assert all(x.rejected for x in other)


def invented(r, syllables, n):
    """Words of one invented language."""
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_op2_limits_follow_centroid_and_length(spark):
    """Paragraphs of a language that was not learned, in the same script, go; short and long texts of those learned stay."""
    import random

    r = random.Random(4)
    syllables = {"aa": "the er in of an re on at nd st".split(), "bb": "de en ie oe ij aa ge ch ver ing".split()}
    rows = [(k, invented(r, syllables[lang], r.choice((3, 20, 80, 300))), lang) for k in range(800) for lang in [("aa", "bb")[k % 2]]]
    rows += [(900, "qzx", "aa"), (901, "%", "aa"), (902, "wholly odd yard glyph 1234 --", "bb")]  # rows unlike all others move no limit of note
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), clusters=2)
    assert model.reach.shape == (len(model.languages), language_id.CLASSES) and (model.reach[:, 6:] < 1).all()
    fresh = [(k, invented(r, syllables[lang], n), lang) for k, (lang, n) in enumerate((lang, n) for lang in syllables for n in (2, 5, 20, 100, 2000) for _ in range(20))]
    kept = language_id.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()
    assert not any(x.rejected for x in kept) and all(x.lang == x.lang_pred for x in kept if len(x.text) > 60)
    other = [(1, invented(r, "o ci ne glia sco pa lu mi to".split(), 80)), (2, "deadbeef0123 " * 60), (3, "for (int i = 0; i < n; i++) { sum += a[i]; }\n" * 20)]
    gone = language_id.predict(spark.createDataFrame(other, "doc_id long, text string"), model).collect()
    assert all(x.rejected for x in gone)


def test_op2_weighs_any_count_exactly():
    counts = np.array([[0, 1, 65_535, 65_536, 1_000_000]])
    assert np.allclose(language_id.log_counts(counts), [[0, 1, *(1 + np.log([65_535, 65_536, 1_000_000]))]])


def test_op2_against_brute_force(spark):
    """Predictions from the model's own centroids, recomputed text by text with plain dictionaries."""
    import random

    r = random.Random(6)
    syllables = {"aa": "the er in of an re".split(), "bb": "de en ie oe ij aa".split(), "cc": "la os el que un ar".split()}
    rows = [(k, invented(r, syllables[lang], r.choice((1, 4, 40))), lang) for k in range(240) for lang in [("aa", "bb", "cc")[k % 3]]] + [(300, "", "aa"), (301, None, "bb"), (302, "123 .", "cc"), (303, "Thé ER", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, clusters=2)
    for x in language_id.predict(docs, model).collect():
        if not x.text or not re.search(r"[^\W\d_]", x.text):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
            continue
        body = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in x.text.lower().encode()) + b" "
        tf = Counter(((body[k] << 16 | body[k + 1] << 8 | body[k + 2]) * 2654435761 % 2**32) >> 19 for k in range(len(body) - 2) if body[k : k + 3] != b"   ")
        vector = {t: (1 + math.log(n)) * float(model.idf[t]) for t, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[t]) for t, v in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda j: cosines[j])
        assert math.isclose(x.score, min(1, cosines[best]), abs_tol=1e-4) and (x.lang_pred == model.languages[best] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4)


def brute_groups(rows):
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = {k: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(fold)) for k, t in rows}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
    sets = {k: {s: n * sum(idf[w] for w in s) / len(s) for s, n in Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))).items()} for k, ws in words.items() if ws}
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum(min(sets[a][s], sets[b][s]) for s in sets[a] if s in sets[b])
            if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k, _ in rows}


def test_op4_against_brute_force(spark):
    import random

    r = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice((3, 60, 150, 400)))]
        if g % 3 == 0:
            base = base + passage
        for _ in range(r.choice((1, 1, 2, 5))):
            words = list(base)
            for _ in range(r.choice((0, 0, 1, 2))):
                words[r.randrange(len(words))] = f"c{r.randrange(10**6)}"
            rows.append((len(rows) * 3, " ".join(words)))
    got = {x.doc_id: x for x in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(rows)
    assert {k: x.group_id for k, x in got.items()} == want
    size = Counter(want.values())
    assert all(x.group_size == size[x.group_id] and x.kept == (k == x.group_id) for k, x in got.items())


def shingle_groups(rows):
    """As brute_groups, with the document frequencies of the shingles themselves."""
    words = {k: t.split() for k, t in rows}
    count = {k: Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) for k, ws in words.items() if ws}
    df = Counter(s for c in count.values() for s in c)
    sets = {k: {s: n * (math.log((1 + len(rows)) / (1 + df[s])) + 1) for s, n in c.items()} for k, c in count.items()}
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum(min(sets[a][s], sets[b][s]) for s in sets[a] if s in sets[b])
            if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k, _ in rows}


def test_op4_weighs_shingles_by_their_own_frequencies(spark, tmp_path):
    """A passage of rare-enough words in many documents weighs little; documents that share it and no more stay apart."""
    import random

    r = random.Random(11)
    passage = " ".join(f"w{r.randrange(400)}" for _ in range(200))
    rows = []
    for g in range(90):
        own = " ".join(f"w{r.randrange(400)}" for _ in range(18 if g % 3 == 0 else 120))
        for c in range(r.choice((1, 1, 2))):
            rows.append((len(rows), f"{passage} {own}" + " end" * c if g % 3 == 0 else own + " end" * c))
    want = shingle_groups(rows)
    assert want != brute_groups(rows) and len(set(want.values())) < len(rows)
    helpers_rows = [(k, t, "en", "a", len(t)) for k, t in rows]
    spark.createDataFrame(helpers_rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.group_id for x in run(spark, str(tmp_path), "op4_near_dedup")} == want


def test_op4_edges(spark, small):
    folder, rows = small
    got = run(spark, folder, "op4_near_dedup")
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].group_id == by[2].group_id == 1 and by[9].group_id == by[10].group_id == 9
    assert by[3].group_size == by[4].group_size == 1 and by[None].group_id is None and by[6].group_id == 6


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (50, 70), (200, 201)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 1 for k in range(2, 31)}, 70: 50, 100: 50, 201: 200}


def test_weighted_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    hits = total = 0
    for _ in range(300):
        keys = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        a = rng.uniform(1, 10, len(keys)).astype(np.float32)
        b = (a * rng.choice((1.0, 0.5), len(keys))).astype(np.float32)
        same = float(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        one = near_dedup.signatures(np.zeros(len(keys), np.int64), keys, a, 1)
        two = near_dedup.signatures(np.zeros(len(keys), np.int64), keys, b, 1)
        hits += int((one == two).sum())
        total += near_dedup.BANDS * same**near_dedup.ROWS
    assert abs(hits / total - 1) < 0.1


def test_staging_leaves_no_shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    there = lambda: {str(f) for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = there(), spark.conf.get(setting)
    pairs = spark.range(100_000, numPartitions=3).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    staged = common.stage(pairs, "test")
    for _ in range(50):  # they go in the background
        if not there() - before:
            break
        time.sleep(0.1)
    assert not there() - before and spark.conf.get(setting) == was
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, pairs.collect())) == [(k, 100) for k in range(1000)]
    common.discard(staged)


def test_op4_counts_the_shingles_of_a_chunk_in_steps(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (3, 5000, 0, 400, 9000, 1, 700)] + [None]
    whole = near_dedup.binary_rows(pa.array(texts, pa.binary()))
    want = np.unique(near_dedup.shingles(*near_dedup.word_hashes(*whole))[1], return_counts=True)
    seen, hashed = [], near_dedup.word_hashes
    monkeypatch.setattr(near_dedup, "_STEP", 2000)
    monkeypatch.setattr(near_dedup, "word_hashes", lambda body, offsets: seen.append((len(body), len(offsets))) or hashed(body, offsets))
    got = near_dedup.distinct(pa.array(texts, pa.binary()))
    assert all(np.array_equal(x, y) for x, y in zip(got, want)) and want[1].max() > 1
    assert len(seen) > 1 and all(size <= 2000 or rows == 2 for size, rows in seen)
