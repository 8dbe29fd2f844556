"""Each operator against a brute-force version on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import math
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bagminhash, bpe, flac, hmm_lm, license_scan, packing, queries, substring_dedup, topk, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


WORDS12 = " ".join(f"w{i}" for i in range(12))


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda module: module.query(spark, sf_dir).collect()


def test_substring_dedup(run, docs):
    words = {d: t.encode().split() for d, t in docs.items()}
    least: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    for r in run(substring_dedup):
        w, gone = words[r.doc_id], set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < r.doc_id:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_narrow_sketch_gives_the_same(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide, narrow = (sorted(map(tuple, substring_dedup.substring_dedup(table, bits=b).select("doc_id", "n_removed", "kept_text").collect())) for b in (20, 6))
    assert wide == narrow


def test_packing(run, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4") for d, x in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(packing):
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, own in ids.items():
        assert [s for s, _ in sorted(pieces[d])] == list(itertools.accumulate([n for _, n in sorted(pieces[d])][:-1], initial=0))
        assert sum(n for _, n in pieces[d]) == len(own)
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 4096
        padding += 4096 - end if end & (end - 1) else 0
    assert padding == 0


@pytest.mark.parametrize("sizes", [[], [1], [4096], [5000, 3, 3], [1, 2, 3, 4095, 4095, 8191], list(range(1, 300)) * 3])
def test_packed_covers_all(sizes):
    held = defaultdict(list)
    for sequence in packing.packed(sizes):
        assert 0 < sum(n for *_, n in sequence) <= 4096
        for doc, start, n in sequence:
            held[doc].append((start, n))
    for doc, size in enumerate(sizes):
        at = 0
        for start, n in sorted(held[doc]):
            assert start == at and n > 0
            at += n
        assert at == size


def test_word_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, t = packing.WordTokenizer(path, keep=3), Tokenizer.from_file(path)
    texts = ["", "a<|endoftext|>b", "DON'T don't", "ΑΣ ΣΑΣ", "é  x\x1cy\x85z", "İstanbul ẞ ß", "١٢ x²", "日本 の", "a" * 300, "퟿\U0001f600 ok"]
    for _ in range(2):
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_inputs_take_time_in_proportion():
    """Ten times the notices, or ten times the word, take about ten times as long."""
    import time

    model = [[[1.0] * toxicity.SYMBOLS for _ in range(toxicity.SYMBOLS)] for _ in range(toxicity.SYMBOLS)]
    notice = " under teh mit license for the use of other words apache license version 2"
    work = {
        "notices": (lambda n: license_scan.scanned((notice * n).encode()), 200),
        "word": (lambda n: toxicity.reading("4b1" * n, model), 2000),
        "letters": (lambda n: toxicity.reading("aab" * n, model), 2000),
    }
    for name, (run, n) in work.items():
        took = []
        for size in (n, 10 * n):
            start = time.process_time()
            run(size)
            took.append(time.process_time() - start)
        assert took[1] < 30 * max(took[0], 0.01), (name, took)


def test_disguises_that_stand_before_or_alone():
    counts = np.full((toxicity.SYMBOLS,) * 3, 0.01)
    for word in ("idiot", "stupid", "hello", "as"):
        s = [0, 0, *map(toxicity.symbol, word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 5
    model = (-np.log(counts / counts.sum(axis=2, keepdims=True))).tolist()
    assert [toxicity.restored(w, model) for w in ("!diot", "1d1ot", "hello!", "(hello)", "s7upid", "@$", "plain")] == ["idiot", "idiot", "hello", "hello", "stupid", "@$", "plain"]


def test_fuzzy_search_against_edit_distance():
    """Words with planted misprints: each notice within its edits of some run of words is found, and none that is not."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(17)
    for phrase in list(license_scan.NOTICES) * 6:
        letters = list(phrase)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(1, len(letters) - 1))
            letters[at : at + int(rng.integers(0, 2))] = [str(rng.choice(list("qz ")))] * int(rng.integers(0, 2))
        text = " some words " + " ".join("".join(letters).split()) + " and others "
        found = license_scan.notices(text)
        words = text.split()
        near = [(distance(p, " ".join(words[i : i + n])), p) for p in license_scan.NOTICES for i in range(len(words)) for n in range(len(p.split()) - 2, len(p.split()) + 3) if n > 0]
        fits = [(d, p) for d, p in near if d <= license_scan.edits(p)]
        assert bool(found) == bool(fits), (phrase, text, found, fits)
        if fits:
            assert min(f[3] for f in found) == min(fits)[0]


def test_license_scan(run, docs):
    for r in run(license_scan):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(docs[r.doc_id]))
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) or not labels
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "phrase", "edits"),
    [("released undr the mit licence today", "under the mit license", 2), ("cc bync", "cc by nc", 1), ("cc by nd", "cc by nd", 0), ("apache license version 1", "apache license version 1", 0), ("under the mpl license", "under the mpl license", 0)],
)
def test_fuzzy_notices(text, phrase, edits):
    assert [(f[2], f[3]) for f in license_scan.notices(f" {text} ")] == [(phrase, edits)]


def _thue_morse(size: int) -> str:
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_of_a_regular_form_have_hashes_of_their_own(spark, size):
    """Modulo a power of two, such a word and its complement share any polynomial hash."""
    one = _thue_morse(size)
    two = one.translate(str.maketrans("ab", "ba"))
    table = spark.createDataFrame([(1, f"{WORDS12} {one}"), (2, f"{WORDS12} {two}"), (3, f"{WORDS12} {two}")], "doc_id long, text string")
    out = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(table).collect()}
    assert out == {1: 0, 2: 0, 3: 13}
    short = spark.createDataFrame([(1, one), (2, two), (3, two)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(short).collect()} == {1: 1, 2: 2, 3: 2}
    known = spark.createDataFrame([(i, one) for i in range(20)] + [(100 + i, two) for i in range(20) if zlib.crc32(str(100 + i).encode()) % 5 == 1], "doc_id long, text string")
    rows = hmm_lm.score(known).collect()
    assert {r.n_known for r in rows if r.doc_id < 100} == {2} and {r.n_known for r in rows if r.doc_id >= 100} == {1}


def test_word_hashes_do_not_depend_on_place():
    from quire.llm import text

    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(33, 127, int(n)).astype(np.uint8)) for n in rng.integers(1, 30, 300)] + [b"x" * (text.CHUNK + 9), b"tail"]
    for joined in (b" ".join(words), b" " * (text.CHUNK - 5) + b" ".join(words[::-1])):
        buf = np.frombuffer(joined, np.uint8)
        hashes, first = text.word_hashes(buf, np.array([0, len(buf)]))
        alone = {w: text.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in words}
        assert hashes.tolist() == [alone[w] for w in joined.split()] and first.tolist() == [0, len(words)]
    assert len(set(alone.values())) == len(set(words))


def test_edits_are_counted_in_characters():
    words = "é日本 x under thé mït license y".encode()
    _, _, found = license_scan.scanned(words)
    assert [(f["label"], f["edits"], f["first_word"], f["end_word"]) for f in found] == [("mit", 2, 2, 6)]


def test_package_paths_carry_their_file_system(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)).startswith("file:")
    assert warc.qualified(spark, f"file://{tmp_path}").startswith("file:")
    with pytest.raises(ValueError, match="without archives"):
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w") as z:
            z.writestr("indexes/index.cdxj", 'com,a)/ 2020 {"offset": "0", "length": "5"}')
        data = blob.getvalue()
        list(warc.records(lambda at, n: data[at : at + n], len(data)))


def test_no_fuzzy_notice():
    assert license_scan.notices(" aapche licens version 2 by words of no licence at all ") == []


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Toxic rows that come last by the hash by which 12,000 were once picked."""
    ids = spark.range(16_500).withColumnRenamed("id", "doc_id")
    last = ids.where(~toxicity.held_out()).orderBy(F.xxhash64("doc_id").desc()).limit(120)
    rows = ids.join(last.withColumn("toxic", F.lit(1)), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = rows.select("doc_id", "toxic", F.when(F.col("toxic") == 1, "a blorvid thing").otherwise("a plain thing").alias("text")).cache()
    out = toxicity.toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).where("predicted = 1")
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows.where("toxic = 1").collect()}


def test_toxicity_decodes_what_can_be_a_known_feature_alone(monkeypatch):
    """Texts of signs, noise, repeated letters and short words: the same features as without a bound on them, by fewer readings."""
    rng = np.random.default_rng(4)
    counts = rng.random((toxicity.SYMBOLS,) * 3) ** 4 + 0.001
    model = (-np.log(counts / counts.sum(axis=2, keepdims=True))).tolist()
    words = ["".join(rng.choice(list("abcssui41$(!µ.-'\")=é_"), rng.integers(1, 12))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 10]) for i in range(0, 3000, 10)]
    full = toxicity.Reader(model)
    found = [full.read(text) for text in texts]
    every = sorted(set().union(*found))
    for size in (1, 5, 40, 400):
        known = dict.fromkeys(rng.choice(every, size).tolist(), 1.0)
        reader = toxicity.Reader(model, known)
        assert [reader.read(text) for text in texts] == [own & known.keys() for own in found]
        again = toxicity.Reader(model, known, keep=3)
        assert [again.read(text) for text in texts[:30]] == [own & known.keys() for own in found[:30]]
    read = []
    monkeypatch.setattr(toxicity, "reading", lambda word, model, own=toxicity.reading: read.append(word) or own(word, model))
    reader = toxicity.Reader(model, {"=idiot": 1.0, "idio": 1.0})
    assert reader.read("p1ain w0rds, sooo pla.in, and so it is or is not a b c") == set() and not read
    assert "=idiot" in toxicity.Reader(model, {"=idiot": 1.0}, lexicon={"idiot": 0.0}).read("an id io t") and read


def test_toxicity_counts_rows_of_the_fit_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i % 2, ["=bad", "x"] if i % 2 else ["=good", "x"]) for i in range(40)], "toxic int, features array<string>")
    weights, _ = toxicity.fitted(rows.mapInArrow(count, rows.schema), ["=bad"], 20, 20)
    assert weights[0] > 0 and seen.value == 40


def test_toxicity(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = toxicity.toxicity(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    seen = Counter((labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels)
    assert seen[0, 1] <= 0.05 * (seen[0, 0] + seen[0, 1]) and seen[1, 1] >= seen[1, 0]
    kept = toxicity.without_toxic(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert kept.columns == table.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_deobfuscation(spark):
    model = toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).tolist()
    for disguised, word in {"s.c.u.m": "scum", "1d10t": "idiot", "tr4sh": "trash", "m0r0n": "moron", "p@th3tic": "pathetic", "stuuupid": "stupid", "2019": "2019", "the": "the"}.items():
        assert toxicity.restored(disguised, model) == word
    assert "=scum" in toxicity.Reader(model).read("you s c u m there")


def test_spacing_is_decoded(spark):
    table, marked = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model, _, _, lexicon = toxicity.classifier(table, marked).value
    reader = toxicity.Reader(model, lexicon=lexicon)
    for text in ("a s c u m", "y o u s c u m", "sc um", "s  c  u  m", "s\nc u m!", "you sc um there", "of $ c u m", "is a s.c um"):
        assert "=scum" in reader.read(text), text
    assert "=moron" in reader.read("a m o r o n") and "=moron" in reader.read("the mor on is")
    assert toxicity.segmented("it is the".split(), reader.part) == ["it", "is", "the"]
    assert not {"=itis", "=isthe"} & reader.read("it is the")


def test_viterbi_is_exact(spark, sf_dir):
    """The decoder's cost is the least over all readings, spelled out one by one."""
    model = toxicity.character_model(spark.read.parquet(f"{sf_dir}/documents.parquet")).tolist()
    for word in ("t0o", "s-1", "aaab", "4@"):
        options = []
        for i, c in enumerate(word):
            own = [(c, toxicity.KEPT)] + [(x, toxicity.READ) for x in toxicity.LEET.get(c, "")]
            if c in toxicity.NOISE:
                own.append(("", toxicity.DROPPED))
            elif i and c == word[i - 1] and c.isalpha():
                own.append(("", toxicity.REPEATED))
            options.append(own)
        best = []
        for path in itertools.product(*options):
            text = "".join(c for c, _ in path)
            s = [0, 0, *map(toxicity.symbol, text), 0]
            best.append((sum(p for _, p in path) + sum(model[a][b][c] for a, b, c in zip(s, s[1:], s[2:])), text))
        assert toxicity.decoded(word, model) == min(best)[1]


def test_flac(run, docs):
    for r in run(flac):
        raw = docs[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_flac_streams():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * n).astype(np.uint8) for n in (1, 3, 130)]
    payloads += [np.full(576, 255, np.uint8), np.tile(np.array([0, 255], np.uint8), 288), (np.arange(1152) % 256).astype(np.uint8)]
    streams = flac.encode(payloads)
    assert all(np.array_equal(a, b) for a, b in zip(flac.decode(streams), payloads))
    stream = streams[2]
    head = flac.Header(np.frombuffer(stream, np.uint8))
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[head.frames :]
    assert np.array_equal(flac.decode([bare])[0], payloads[2])
    # a frame on its own, from its offset in the seek table
    samples, _ = flac.frames_at(np.frombuffer(stream, np.uint8), np.array([head.frames + head.points[7]]), head)
    assert np.array_equal((samples[0][0].astype(int) + 128).astype(np.uint8), payloads[2][7 * 576 : 8 * 576])
    for at in (head.frames + 1, head.frames + 20, len(stream) - 1, len(stream) - 40):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises((flac.Damaged, ValueError, IndexError)):
            flac.decode([bytes(broken)])


def _bits(fields: list[tuple[int, int]]) -> bytes:
    text = "".join(f"{v & (1 << n) - 1:0{n}b}" for v, n in fields if n)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def _frame(body: list[tuple[int, int]]) -> bytes:
    raw = flac.frame_head(0) + _bits(body)
    crc = int(flac.crc16(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
    return raw + crc.to_bytes(2, "big")


def test_flac_subframes_of_other_encoders():
    """Constant, verbatim, linear prediction, partitions with escapes, and long unary parts."""
    rng = np.random.default_rng(3)
    samples = rng.integers(-128, 128, 576)
    frames = [(_frame([(0, 8), (-5, 8)]), np.full(576, -5)), (_frame([(1 << 1, 8), *((int(v), 8) for v in samples)]), samples)]

    def rice(v: int, k: int) -> list[tuple[int, int]]:
        u = (v << 1) ^ (v >> 31)
        return [(0, u >> k), (1, 1), (u, k)]

    smooth = np.clip(np.cumsum(rng.integers(-2, 3, 576)), -100, 100)
    weights, shift = [7, -3], 2
    body = [((32 + 1) << 1, 8), (int(smooth[0]), 8), (int(smooth[1]), 8), (4 - 1, 4), (shift, 5), *((w, 4) for w in weights), (0, 2), (2, 4)]
    for p in range(4):
        rows = range(max(2, 144 * p), 144 * (p + 1))
        values = [int(smooth[i]) - ((weights[0] * int(smooth[i - 1]) + weights[1] * int(smooth[i - 2])) >> shift) for i in rows]
        if p == 2:
            body += [(15, 4), (10, 5), *((v, 10) for v in values)]
        else:
            body += [(p, 4)] + [b for v in values for b in rice(v, p)]
    frames.append((_frame(body), smooth))
    body = [(8 << 1, 8), (0, 2), (0, 4), (0, 4)] + [b for v in samples for b in rice(int(v), 0)]
    frames.append((_frame(body), samples))
    head = flac.Header(np.frombuffer(flac.encode([np.zeros(576, np.uint8)])[0], np.uint8))
    got, _ = flac.frames_at(np.frombuffer(b"".join(f for f, _ in frames), np.uint8), np.cumsum([0] + [len(f) for f, _ in frames[:-1]]), head)
    for row, (_, want) in zip(got, frames):
        assert np.array_equal(row[0], want)


def _stereo(left: np.ndarray, right: np.ndarray, block: int, bits: int, seek: bool) -> bytes:
    """A stream of two channels, each kind of stereo in turn, blocks of another size, the last one short, wasted bits."""

    def rice(v: int, k: int) -> list[tuple[int, int]]:
        u = (v << 1) ^ (v >> 63)
        return [(0, u >> k), (1, 1), (u, k)]

    def subframe(x: list[int], width: int, order: int) -> list[tuple[int, int]]:
        if all(v % 4 == 0 for v in x):
            return [(8 << 1 | 1, 8), (1, 2), *rest([v >> 2 for v in x], width - 2, 0)]
        return [(8 + order << 1, 8), *rest(x, width, order)]

    def rest(x: list[int], width: int, order: int) -> list[tuple[int, int]]:
        r = x
        for _ in range(order):
            r = [b - a for a, b in zip(r, r[1:])]
        # five-bit parameters in one partition
        return [*((v, width) for v in x[:order]), (1, 2), (0, 4), (9, 5)] + [b for v in r for b in rice(v, 9)]

    made, points, at = [], [], 0
    for number, low in enumerate(range(0, len(left), block)):
        l, r = (x[low : low + block].tolist() for x in (left, right))
        mode = (1, 8, 9, 10)[number % 4]
        side = [a - b for a, b in zip(l, r)]
        first, second = {1: (l, r), 8: (l, side), 9: (side, r), 10: ([(a + b) >> 1 for a, b in zip(l, r)], side)}[mode]
        code = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits]
        head = bytes([0xFF, 0xF8, 7 << 4 | 13, mode << 4 | code << 1]) + flac.coded_number(number) + (len(l) - 1).to_bytes(2, "big") + (44100).to_bytes(2, "big")
        raw = head + bytes([flac.crc8(head)]) + _bits([*subframe(first, bits + (mode == 9), number % 5), *subframe(second, bits + (mode in (8, 10)), 2)])
        raw += int(flac.crc16(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
        points.append(low.to_bytes(8, "big") + at.to_bytes(8, "big") + len(l).to_bytes(2, "big"))
        made.append(raw)
        at += len(raw)
    packed = 44100 << 44 | 1 << 41 | (bits - 1) << 36 | len(left)
    samples = np.stack([left, right], axis=1).astype({8: np.int8, 16: np.int16}.get(bits, np.int32))
    info = block.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(flac.pcm(samples, bits)).digest()
    table = b"".join(points)
    return b"fLaC" + bytes([0 if seek else 0x80]) + len(info).to_bytes(3, "big") + info + (bytes([0x83]) + len(table).to_bytes(3, "big") + table if seek else b"") + b"".join(made)


@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("seek", [True, False])
def test_flac_stereo_of_other_sizes(bits, seek, spark):
    rng = np.random.default_rng(bits)
    left = np.clip(np.cumsum(rng.integers(-90, 91, 2500)), -(1 << bits - 1), (1 << bits - 1) - 1)
    right = left // 3 + rng.integers(-5, 6, 2500)
    left[1200:1800] = left[1200:1800] // 4 * 4
    stream = _stereo(left, right, 600, bits, seek)
    [(head, samples, marks)] = flac.read([np.frombuffer(stream, np.uint8)])
    assert (head.bits, head.channels, head.rate) == (bits, 2, 44100)
    assert np.array_equal(samples, np.stack([left, right], axis=1)) and marks[:, 1].tolist() == [0, 600, 1200, 1800, 2400]
    rows = flac.pcm_blocks(spark.createDataFrame([(5, stream), (6, None)], "doc_id long, media binary")).orderBy("block").collect()
    assert [(r.doc_id, r.sample_offset) for r in rows] == [(5, 600 * i) for i in range(5)]
    assert b"".join(r.pcm for r in rows) == flac.pcm(samples, bits)
    assert all(stream[r.byte_offset : r.byte_offset + 2] == b"\xff\xf8" for r in rows)


def test_flac_null_media(spark):
    rows = [(1, 3, None), (2, 3, flac.encode([np.full(576, 7, np.uint8)])[0])]
    out = {r.doc_id: r for r in flac.load(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert out[1].payload is None and out[1].feature is None and bytes(out[2].payload) == bytes([7]) * 576


def test_flac_uses_linear_prediction():
    wave = (128 + 90 * np.sin(np.arange(5760) / 3)).astype(np.uint8)
    [stream] = flac.encode([wave])
    assert len(stream) < len(wave) // 2 and np.array_equal(flac.decode([stream])[0], wave)


def test_flac_memory_does_not_follow_a_text():
    """One text of 32 MB, stored and loaded, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from quire.llm import flac
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = b"some words of a text, 7 times over. " * (32 * 2**20 // 36)
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.binary())], ["doc_id", "bytes"])
size = len(text)
[stored] = flac._stored(iter([batch]))
one = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
[loaded] = flac._loaded(iter([stored]))
two = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert loaded.column("payload")[0].as_py()[:size] == text
print((one - base) // 1024, (two - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr
    one, two = map(int, out.stdout.split())
    assert one < 300 and two < 420, out.stdout  # text, batch and stream are all held here


def test_pcm_blocks(spark):
    rows = flac.pcm_blocks(flac.store(spark.createDataFrame([(1, "x" * 1500)], "doc_id long, text string"))).orderBy("block").collect()
    assert [r.sample_offset for r in rows] == [0, 576, 1152] and bytes(b ^ 0x80 for b in rows[0].pcm) == b"x" * 576


def test_language_model(run, docs):
    tokens = {d: [*lower(t).encode().split(), None] for d, t in docs.items()}
    count = Counter(x for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for x in w)
    n, v = sum(count.values()), len(count)
    out = run(hmm_lm)
    for r in out:
        w = tokens[r.doc_id]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


MODEL = {"start": np.array([0.3, 0.7]), "move": np.array([[0.9, 0.1], [0.2, 0.8]]), "emit": np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])}


def paths(s):
    for z in itertools.product((0, 1), repeat=len(s)):
        yield z, MODEL["start"][z[0]] * MODEL["emit"][z[0], s[0]] * np.prod([MODEL["move"][z[i - 1], z[i]] * MODEL["emit"][z[i], s[i]] for i in range(1, len(s))])


def test_forward_and_baum_welch_against_all_paths():
    sequences = [[0, 1, 2, 2], [0, 1], [2]]
    flat, first = np.array(sum(sequences, [])), np.array([0, 4, 6, 7])
    assert hmm_lm.forward(flat, first, MODEL) == pytest.approx([math.log10(sum(p for _, p in paths(s))) for s in sequences])
    starts, moves, emitted = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s in sequences:
        total = sum(p for _, p in paths(s))
        for z, p in paths(s):
            starts[z[0]] += p / total
            for a, b in zip(z, z[1:]):
                moves[a, b] += p / total
            for x, state in zip(s, z):
                emitted[x, state] += p / total
    for got, want in zip(hmm_lm.expected(flat, first, MODEL), (starts, moves, emitted)):
        assert got == pytest.approx(want, rel=1e-4)


def test_byte_bpe(run, docs):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(bpe):
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_byte_bpe_on_odd_texts():
    import random

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, split = bpe.Transducer(ranks, states=500, memo=50), bpe.Splitter(public_tokenizers.PATTERN)
    chance = random.Random(5)
    signs = [chr(c) for c in (*range(0x250), *range(0x3A0, 0x480), *range(0x2000, 0x2040), *range(0x4E00, 0x4E40), 0x1F600, 0x200D, 0x3000)]
    texts = ["", "a" * 9000, "xyz" * 3000, *("".join(chance.choices(signs if i % 2 else "aeinrst \n'", k=40)) for i in range(500))]
    decoder = bpe.Utf8Machine()
    for text in texts:
        ids = machine.encode(text, split).tolist()
        assert ids == reference.encode_ordinary(text)
        assert decoder.decode(machine.bytes_of[i] for i in ids) == text


def test_utf8_machine_on_broken_streams():
    assert bpe.Utf8Machine().decode([b"\xe2", b"\x82", b"\xac"]) == "€"
    machine = bpe.Utf8Machine()
    assert [machine.feed(x) for x in (b"\xf0\x9f", b"\x98", b"\x80a")] == ["", "", "\U0001f600a"]
    assert bpe.Utf8Machine().decode([b"a\xe2b", b"\xff", b"\xed\xa0\x80", b"\xc3"]) == "a�b�����"


def test_top_k(run, spark, sf_dir):
    rows = {r.vec_id: np.floor(np.array(r.embedding, float) * 256).astype(int) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    want = []
    for q in (i for i in rows if i % 50 == 0):
        best = sorted(((-int(rows[q] @ v), i) for i, v in rows.items() if i != q))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, run(topk))) == sorted(want)


def test_top_k_sql(run, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(con.sql(topk.SQL).fetchall()) == sorted(map(tuple, run(topk)))


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (50, [1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = defaultdict(list)
    for r in sorted(out):
        got[r.query_id].append((r.vec_id, r.score))
    unit = 256 * 256
    assert got == {0: [(5, 5 * unit), (6, 5 * unit), (50, unit), (50, unit), (7, 0)], 50: [(0, unit), (5, unit), (6, unit), (7, 0)]}


@pytest.mark.parametrize("size", [1, 1 << 25])
def test_top_k_repeated_rows(spark, size):
    """Every row three times, in one block: a query's own rows take no other row's place."""
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.integers(-9, 10, 4) * size] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(vectors) for _ in range(3)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), every=10, scale=1).collect()
    want = []
    for q in range(0, 40, 10):
        scores = sorted((-int(sum(a * b for a, b in zip(vectors[q], v))), i) for i, v in rows if i != q)
        want += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in out) == want


def test_top_k_prunes_blocks_and_is_exact(spark, monkeypatch):
    """Ids in clusters: a query meets few of the blocks, in cells of many groups and shelves."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 16))
    x = np.floor(60 * (np.repeat(centres, 40, axis=0) + 0.05 * rng.normal(size=(1200, 16)))).astype(np.int64)
    ids = np.arange(1200)
    blocks = [(ids[i : i + 40], x[i : i + 40], x[i : i + 40].max(axis=0), x[i : i + 40].min(axis=0)) for i in range(0, 1200, 40)]
    asked = ids % 10 == 0
    (query, vec, score), met = topk.best(ids[asked], x[asked], blocks, 5, np.full(asked.sum(), np.iinfo(np.int64).min))
    scores = x[asked] @ x.T
    scores[ids[None, :] == ids[asked][:, None]] = -(1 << 60)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert vec.reshape(-1, 5).tolist() == order.tolist() and score.reshape(-1, 5).tolist() == np.take_along_axis(scores, order, 1).tolist()
    assert met < 0.5 * asked.sum() * len(blocks)
    # floors from elsewhere leave fewer still, and the same rows
    floor = np.sort(scores, axis=1)[:, -5]
    again, fewer = topk.best(ids[asked], x[asked], blocks, 5, floor)
    assert fewer <= met and [a.tolist() for a in again] == [query.tolist(), vec.tolist(), score.tolist()]
    for name, value in {"BLOCK": 40, "SHELF": 7, "QUERIES": 16, "SEEDS": 3}.items():
        monkeypatch.setattr(topk, name, value)
    out = topk.top_k(spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), every=10, scale=1).collect()
    want = [(int(q), n + 1, int(v), int(scores[i, v])) for i, q in enumerate(ids[asked]) for n, v in enumerate(order[i])]
    assert sorted(tuple(r) for r in out) == want


def test_warc(run, spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    least: dict[bytes, int] = {}
    for p, h in pages.items():
        least[h] = min(least.get(h, p), p)
    out = run(warc)
    assert len(out) == len(pages)
    for r in out:
        h = pages[r.page_id]
        own = least[h] == r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if own else "revisit", None if own else least[h])


def test_warc_revisits(spark):
    rows = [(5, "u", "same"), (3, None, "same"), (9, "u v\n", "same"), (1, "u", None), (2, "u", ""), (None, "u", "same"), (3, "u", "same")]
    out = warc.read_packages(warc.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in out.collect()), key=repr)
    assert got == sorted([(5, "revisit", 3), (3, "response", None), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "revisit", 1), (0, "response", None)], key=repr)


def test_packages_are_files_read_by_ranges(spark):
    from pathlib import Path

    pages = spark.createDataFrame([(i, "u", "payload %d " % i * 400, "x", i) for i in range(300)], "page_id long, url string, html string, content string, size long")
    made = warc.write_packages(pages, limit=1 << 17).persist()
    [first, *rest] = made.collect()
    assert len(rest) > 3 and first.content is None and first.path.startswith("file:")
    file = Path(first.path.removeprefix("file:").replace("//", "/")).read_bytes()
    assert len(file) == first.size and zipfile.ZipFile(warc.io.BytesIO(file)).testzip() is None
    asked = []
    got = list(warc.records(lambda at, n: asked.append(n) or file[at : at + n], len(file)))
    # behind the tail, directory, local headers and index, one range a record
    assert len(got) == len([n for n in asked if n < len(file) // 4]) - 4 and max(asked[1:]) < len(file) // 4
    back = {r.page_id: bytes(r.payload) for r in warc.read_packages(made).collect()}
    assert back == {i: ("payload %d " % i * 400).encode() for i in range(300)}
    nothing = spark.createDataFrame([(None, None)], "path string, content binary")
    assert warc.read_packages(nothing).collect() == []


def test_foreign_packages():
    """Other member names, compressed and missing indexes, plain archives, records of other kinds and ids."""
    made = [warc.record(i, "http://x", b"body %d" % i, None) for i in range(3)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    squeeze = lambda raw: (press := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(raw) + press.flush()
    parts = [squeeze(x) for x in (info, *made)]
    lines, at = ["!meta {}"], 0
    for x in parts:
        lines.append("com,example)/ 2020 " + warc.json.dumps({"url": "http://x", "filename": "a.warc.gz", "offset": str(at), "length": str(len(x))}))
        at += len(x)
    for extra in ({"archive/a.warc.gz": b"".join(parts), "indexes/index.cdx.gz": squeeze("\n".join(lines).encode())}, {"archive/a.warc.gz": b"".join(parts)}, {"b.warc": info + b"".join(made)}):
        out = warc.io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in {"datapackage.json": b"{}", **extra}.items():
                z.writestr(name, body)
        content = out.getvalue()
        got = list(warc.records(lambda at, n: content[at : at + n], len(content)))
        assert [r["payload"] for r in got] == [b"a: b\n", b"body 0", b"body 1", b"body 2"]
        assert [r["page_id"] for r in got] == [None, 0, 1, 2] and got[0]["record_id"] == "<urn:uuid:1>" and got[0]["record_type"] == "warcinfo"


def test_zip64_directories(monkeypatch):
    made = [warc.record(i, "http://x", b"body %d" % i, None) for i in range(5)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    content = warc.package(made)
    assert b"PK\x06\x06" in content
    asked = []

    def fetch(at: int, n: int) -> bytes:
        asked.append(n)
        return content[at : at + n]

    assert [r["payload"] for r in warc.records(fetch, len(content))] == [b"body %d" % i for i in range(5)]
    assert max(asked[1:]) < len(content)


def grams(text: str) -> Counter:
    w = lower(text).encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def components_of(texts: dict[int, str]) -> dict[int, int]:
    bags = {d: grams(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        shared = sum((bags[a] & bags[b]).values())
        total = sum(bags[a].values()) + sum(bags[b].values()) - shared
        if (total == 0 or shared >= 0.8 * total) and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: find(d) for d in texts}


def test_near_duplicates(run, docs):
    want = components_of(docs)
    assert {r.doc_id: (r.class_id, r.kept) for r in run(bagminhash)} == {d: (c, c == d) for d, c in want.items()}


def test_near_duplicates_in_a_family_without_a_centre(spark):
    """Copies of copies: links form chains, and pairs of the family lie on either side of the threshold."""
    import random

    chance = random.Random(2)
    words = [f"w{chance.randrange(400)}" for _ in range(120)]
    texts = {}
    for i in range(90):
        texts[i] = " ".join(words)
        if i % 3 == 0:
            words = list(words)
            for _ in range(2):
                words[chance.randrange(120)] = f"n{i}{chance.random()}"
    texts[90], texts[91] = "alpha beta", "ALPHA  beta"
    want = components_of(texts)
    out = bagminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in out.collect()} == want


def test_signatures_estimate_weighted_jaccard():
    chance = np.random.default_rng(4)
    for _ in range(5):
        weights = chance.integers(0, 12, (2, 300))
        owner, value, weight = (np.concatenate(x) for x in zip(*((np.full((w > 0).sum(), i), np.flatnonzero(w > 0).astype(np.uint64), w[w > 0]) for i, w in enumerate(weights))))
        a, b = bagminhash.signatures(owner, value, weight, 2, 2048)
        true = np.minimum(*weights).sum() / np.maximum(*weights).sum()
        assert (a == b).mean() == pytest.approx(true, abs=0.045)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "one two three four five " * 6), (5, "one two three four five " * 6), (None, "no id but words " * 9), (None, None), (6, " \n\t "), (7, "ÄÖ \U0001f600 é " * 5), (8, "lang wort " * 30000), (9, "x" * 200000)]
EXTRA = "doc_id long, text string, h1 long, node long, kept boolean, label string, bytes binary, team long, score double, rest string, row string, n int"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, True, "l", b"b", 3, 0.5, "r", "w", 7) for r in rows], EXTRA)


def labels(spark, rows=((1, 1), (3, 0), (4, 1), (5, None), (None, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


RUNS = {
    "substring": lambda s, d: substring_dedup.substring_dedup(d),
    "near": lambda s, d: bagminhash.near_duplicates(d),
    "license": lambda s, d: license_scan.license_scan(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "flac": lambda s, d: flac.load(flac.store(d)),
    "hmm": lambda s, d: hmm_lm.score(d),
    "bpe": lambda s, d: bpe.decode(bpe.encode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
}


def test_round_trip_is_encoding_and_decoding(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    two = RUNS["bpe"](spark, odd(spark)).collect()
    one = bpe.round_trip(odd(spark), path, public_tokenizers.PATTERN).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    out = RUNS[name](spark, odd(spark)).collect()
    assert len(out) == len(ODD)
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in ODD)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, odd(spark, [])).collect() == []


def test_packing_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(odd(spark), path).collect()
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(d for d, _ in ODD)
    assert {r.doc_tokens for r in out if r.doc_id in (1, 2, 6)} == {1}
    assert packing.pack(odd(spark, []), path).collect() == []


def test_odd_values(spark):
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(odd(spark)).collect() if r.doc_id is not None}
    assert (out[4].n_removed, out[5].n_removed, out[1].n_words, out[5].kept_text) == (0, 30, 0, "")
    classes = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(odd(spark)).collect() if r.doc_id is not None}
    assert classes[2] == classes[6] == classes[1] == 1 and classes[4] == classes[5] == 4 and classes[3] == 3
    scores = [r for r in hmm_lm.score(odd(spark)).collect() if r.doc_id == 3]
    assert len(scores) == 2 and scores[0].base_score == scores[1].base_score and scores[0].n_tokens == 2


def test_pages_and_vectors_empty(spark):
    assert warc.read_packages(warc.write_packages(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_ids_with_several_texts_are_compared_by_each(spark):
    rng = np.random.default_rng(8)
    a, c = (" ".join(f"w{i}" for i in rng.integers(0, 10**6, 90)) for _ in range(2))
    rows = [(5, a), (5, c), (4, c + " more"), (9, a), (7, "alone here")]
    out = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in out) == [(4, 4, True), (5, 4, False), (5, 4, False), (7, 7, True), (9, 5, False)]


def test_vectors_and_pages_with_clashing_columns_and_long_payloads(spark):
    rows = [(i, [float(i % 7), 1.0], b"x", b"y", 1, 2, 3, 4.0, [9]) for i in range(0, 200, 10)]
    plain = topk.top_k(spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>")).collect()
    wide = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids binary, vectors binary, g int, s int, number long, score double, v array<int>")).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, wide)) and plain
    long = "é<p>text</p> " * 500_000
    pages = spark.createDataFrame([(1, "u", long, "p", 5), (2, "u", long, "p", 6), (3, "u", "x", "p", 7)], "page_id long, url string, html string, path string, size long")
    back = {r.page_id: r for r in warc.read_packages(warc.write_packages(pages)).collect()}
    assert [back[i].record_type for i in (1, 2, 3)] == ["response", "revisit", "response"] and bytes(back[1].payload) == long.encode() and back[2].payload_bytes == len(long.encode())


def test_every_operator_has_a_query():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
