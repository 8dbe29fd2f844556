"""Toxicity behind noisy-channel deobfuscation.

Words that look disguised (figures or signs between letters, letters spelled out with dots, runs of one letter) and runs of
short words become character lattices: a sign may stand for a letter, a separator or a repeated letter may be noise, a
space may be a word's edge or noise. Viterbi decoding under a character trigram model of the whole corpus, and in runs the
words of the labelled rows, picks the likeliest reading. Restored words are then scored by a logistic model over words
and word beginnings, fitted on all labelled rows that are not held out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm.text import binary_view, dropped, lean, lower_ascii, row_chunks, trimmed, whole_text, written

#: Steps and penalty of the classifier's fit.
STEPS, PENALTY = 60, 0.02
#: Words and word beginnings that the classifier weighs at most.
FEATURES = 2_000
#: Words that runs of short words are decoded with at most, besides those that the classifier weighs.
LEXICON = 50_000
#: Letters that a sign can stand for, and signs that can stand between letters for nothing.
LEET = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "€": "e", "6": "g", "9": "g", "1": "il", "!": "i", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "µ": "u"}
NOISE = ".-_*~'`,/\\:"
SIGNS = re.escape("".join(LEET) + NOISE)
#: A disguised word: a sign next to letters on both sides, a letter three times running, or nothing but signs.
DISGUISED = re.compile(rf"[^\W\d_][{SIGNS}]+[^\W\d_]|[{re.escape(''.join(LEET))}][^\W\d_]|[^\W\d_][{re.escape(''.join(LEET))}]|([^\W\d_])\1\1|^[{re.escape(''.join(c for c in LEET if not c.isdigit()))}]{{3,}}$")
#: Where the lattice of a word has more than one path.
BRANCHES = re.compile(rf"[{SIGNS}]|([^\W\d_])\1")
EDGE = ".,;:!?\"'()[]{}<>«»„“”‚‘’…-–—*_~`"
OUTER = frozenset(EDGE)
#: Two or more words of up to three characters, closing signs aside, behind a space, which is found sooner than a word's edge.
SHORT = re.compile(r"\s(\S{1,3}[.,;:!?]*(?:\s+\S{1,3}[.,;:!?]*)+(?!\S))")
#: Three or more single characters within such a run.
SPELLED = re.compile(r"(?<!\S)[^\W_](?:\s+[^\W_]){2,}(?!\S)")
#: Characters of a word put together from short words at most.
LONGEST = 32
#: Symbols of the character model: 0 the word's edge, 1 to 26 letters, 27 figures, 28 bytes of other letters, 29 the rest.
SYMBOLS = 30
#: Characters by which words that cannot have a known feature are told.
HEAD = 8
KEPT, READ, DROPPED, REPEATED, JOINED = 0.05, 1.0, 1.5, 1.5, 1.0


def _symbol_table() -> np.ndarray:
    table = np.full(256, 29, np.int64)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[97:123] = np.arange(1, 27)
    table[48:58] = 27
    table[128:] = 28
    return table


def symbol(char: str) -> int:
    code = ord(char)
    return code - 96 if 97 <= code <= 122 else 27 if 48 <= code <= 57 else 28 if char.isalpha() else 29


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            buf, at = binary_view(part.column("bytes"))
            s = np.insert(table[lower_ascii(buf)], at, 0)
            s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]] if len(s) else s
            s = np.repeat(s, np.where(s == 0, 2, 1))
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """-log P(c | a, b) of the words of all documents, add-half smoothed, by symbols."""
    counts = lean(docs).select(whole_text().alias("bytes")).mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    table = np.full(SYMBOLS**3, 0.5)
    for r in counts.collect():  # at most 27,000 rows
        table[r["trigram"]] += r["n"]
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return -np.log(table / table.sum(axis=2, keepdims=True))


class _Symbols(dict):
    def __missing__(self, char: str) -> int:
        self[char] = out = symbol(char)
        return out


_SYMBOL = _Symbols()


def reading(word: str, model: list) -> tuple[float, str]:
    """The likeliest reading of a lower-case word under the channel and the character model, and its cost before it."""
    if not BRANCHES.search(word):
        # one path: each character as it stands
        a = b = 0
        cost = KEPT * len(word)
        for s in map(_SYMBOL.__getitem__, word):
            cost += model[a][b][s]
            a, b = b, s
        return cost + model[a][b][0], word
    # each state has its cost and its last character, which points to the one before
    best: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
    for i, char in enumerate(word):
        options = [(char, KEPT, _SYMBOL[char])] + [(letter, READ, _SYMBOL[letter]) for letter in LEET.get(char, "")]
        drop = DROPPED if char in NOISE else REPEATED if i and char == word[i - 1] and char.isalpha() else None
        after: dict[tuple[int, int], tuple] = {}
        for (a, b), (cost, trail) in best.items():
            row = model[a][b]
            for c, price, s in options:
                total = cost + price + row[s]
                known = after.get((b, s))
                if known is None or total < known[0]:
                    after[b, s] = total, (trail, c)
            if drop is not None:
                known = after.get((a, b))
                if known is None or cost + drop < known[0]:
                    after[a, b] = cost + drop, trail
        best = after
    cost, trail = min(((cost + model[a][b][0], trail) for (a, b), (cost, trail) in best.items()), key=lambda x: x[0])
    out = []
    while trail:
        trail, c = trail
        out.append(c)
    return cost, "".join(reversed(out))


def decoded(word: str, model: list) -> str:
    return reading(word, model)[1]


def restored(word: str, model: list) -> str:
    """A lower-case word without its outer signs, decoded if it looks disguised."""
    bare = word.strip(EDGE)
    if word.startswith("!") and word[1:2].isalpha():
        # may stand for a letter: it goes if it is read as a sign
        bare = "!" + bare
    # what is disguised has signs or letters twice running, which are found sooner
    return decoded(bare, model).strip(EDGE) if BRANCHES.search(bare) and DISGUISED.search(bare) else bare


def segmented(tokens: list[str], read) -> list[str]:
    """The likeliest words of a run of short words, each space a word's edge or dropped; ``read`` gives a word's cost and text."""
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    for end in range(1, len(tokens) + 1):
        word, found = "", None
        for start in range(end - 1, -1, -1):
            word = tokens[start] + word
            if len(word) > LONGEST and start < end - 1:
                break
            cost, text = read(word)
            cost += best[start][0] + JOINED * (end - start - 1)
            if found is None or cost < found[0]:
                found = cost, start, text
        best.append(found)
    words, at = [], len(tokens)
    while at:
        words.append(best[at][2])
        at = best[at][1]
    return words[::-1]


def features(word: str) -> list[str]:
    """The word and its beginnings of four to six characters."""
    return [f"={word}"] + [word[:n] for n in (4, 5, 6) if len(word) >= n] if word else []


NONE: list[str] = []


class Reader:
    """Words of texts as features, with those of words met before kept up to a bound. With ``known``, features in it alone."""

    def __init__(self, model: list, known: dict[str, float] | None = None, keep: int = 200_000, lexicon: dict[str, float] | None = None):
        self.model, self.known, self.keep, self.memo = model, known, keep, {}
        self.lexicon, self.parts, self.runs, self.blank, self.heads = lexicon or {}, {}, {}, set(), {}
        # how a word with a known feature begins, or all of it; a word may begin with = itself
        self.starts = {w[:HEAD] for f in known or () for w in ((f[1:], f) if f[0] == "=" else (f,))}
        self.stems = {w[:n] for w in self.starts for n in range(len(w))}

    def hopeful(self, text: str, at: int = 0) -> bool:
        """Whether a word that stands at ``at`` can have a known feature, however it is read and read again, and wherever it ends.

        False is certain, and most words end here after four characters.
        """
        for n in (4, HEAD):
            head = text[at : at + n]
            out = self.heads.get(head)
            if out is None:
                if len(self.heads) >= self.keep:
                    self.heads.clear()
                # four characters come first as the beginning of more, which holds for a word of four as well
                out = self.heads[head] = self.follow(head, len(head) == n)
            if not out:
                return False
        return self.follow(text[at : at + 4 * LONGEST], len(text) > at + 4 * LONGEST)

    def follow(self, head: str, more: bool) -> bool:
        """Whether a word that begins with ``head`` can have a known feature; it is more than that with ``more``."""
        if OUTER.isdisjoint(head) and not BRANCHES.search(head):
            # every reading begins so
            return any(head[:n] in self.starts for n in range(1, HEAD + 1)) or more and head in self.stems
        stems, before = {""}, ""
        for char in head:
            options = char + LEET.get(char, "")
            dropped = char in NOISE or char == before and char.isalpha()
            after = {stem + c for stem in stems for c in options}
            if not after.isdisjoint(self.starts):
                return True
            after &= self.stems
            # noise goes, outer signs go, and a letter that is read as the one before may be taken for its repetition
            after.update(stem for stem in stems if dropped or (stem[-1] in options if stem else char in OUTER))
            if not after:
                return False
            stems, before = after, char
        return more

    def part(self, word: str) -> tuple[float, str]:
        """Cost and text of a word of a run: what the character model reads, at the lexicon's cost where that is less."""
        out = self.parts.get(word)
        if out is None:
            bare = word.strip(EDGE)
            cost, text = reading(bare, self.model)
            text = text.strip(EDGE)
            for known in {bare, text}:
                if self.lexicon.get(known, cost) < cost:
                    cost, text = self.lexicon[known], known
            if len(self.parts) >= self.keep:
                self.parts.clear()
            out = self.parts[word] = cost, text
        return out

    def promising(self, tokens: list[str]) -> bool:
        """Whether a word put together from these tokens can have a known feature."""
        text, at = "".join(tokens), 0
        for token in tokens:
            if self.hopeful(text, at):
                return True
            at += len(token)
        return False

    def run(self, run: str) -> set[str]:
        """Features of a run of short words."""
        out = self.runs.get(run)
        if out is None:
            tokens = run.split()
            if self.known is None or self.promising(tokens):
                words = segmented(tokens, self.part)
                # letters alone are also read as one word
                words += ["".join(m[0].split()) for m in SPELLED.finditer(run)]
                out = {f for w in words for f in self.of(w)}
            else:
                out = set()
            if len(run) <= 4 * LONGEST:
                if len(self.runs) >= self.keep:
                    self.runs.clear()
                self.runs[run] = out
        return out

    def of(self, word: str) -> list[str]:
        out = NONE if word in self.blank else self.memo.get(word)
        if out is None:
            if self.known is None:
                out = features(restored(word, self.model))
            else:
                out = [f for f in features(restored(word, self.model)) if f in self.known] if self.hopeful(word) else NONE
            if out:
                if len(self.memo) >= self.keep:
                    self.memo.clear()
                self.memo[word] = out
            else:
                if len(self.blank) >= self.keep:
                    self.blank.clear()
                self.blank.add(word)
        return out

    def read(self, text: str) -> set[str]:
        text = text.lower()
        words = set(text.split())
        found: set[str] = set()
        for run in set(SHORT.findall(" " + text)):
            found |= self.run(run)
        # most words say nothing and are passed over together
        for word in words - self.blank if self.known is None else [w for w in words - self.blank if self.heads.get(w[:4], True)]:
            found.update(self.of(word))
        return found


def _featured(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    reader = Reader(sent.value)
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            found = [sorted(reader.read(x.as_py().decode())) for x in part.column("bytes")]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "features"])


def fitted(rows: DataFrame, names: list[str], good: int, bad: int) -> tuple[np.ndarray, float]:
    """Weights of the features ``names`` and the bias of a logistic model of all ``rows`` (toxic, features), of which ``good`` are
    not toxic and ``bad`` are: the penalised likelihood is summed where the rows are, and rows alike count as one of their number."""
    if not names or not good or not bad:
        return np.zeros(len(names)), math.log((bad + 1) / (good + 1))
    # a set of the names made once; and rows counted once, as the fit reads them several times
    own = F.array_sort(F.filter("features", lambda f: f.isin(names)))
    alike = written(rows.select(F.col("toxic").cast("double").alias("label"), own.alias("own")).groupBy("label", "own").agg(F.count("*").cast("double").alias("weight")))
    vectors = CountVectorizerModel.from_vocabulary(names, "own", "vector").transform(alike).select("label", "vector", "weight")
    found = LogisticRegression(featuresCol="vector", weightCol="weight", maxIter=STEPS, regParam=PENALTY / (good + bad), standardization=False).fit(vectors)
    dropped(alike)
    return found.coefficients.toArray(), float(found.intercept)


def counted(rows: DataFrame) -> DataFrame:
    """In how many of all ``rows`` (toxic, features) and of the toxic ones each feature is, three at least."""
    return rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where("n >= 3")


def telling(counts: DataFrame, good: int, bad: int, limit: int) -> list[str]:
    """Of features more often in toxic rows than not, in three of them at least, those furthest from chance."""
    rate = bad / max(1, good + bad)
    gain = (F.col("bad") - F.col("n") * rate) / F.sqrt(F.greatest(F.col("n") * (rate * (1 - rate)), F.lit(1e-9)))
    best = counts.where((F.col("bad") >= 3) & (F.col("bad") > 0.5 * F.col("n"))).orderBy(gain.desc(), "feature").limit(limit)
    return [r["feature"] for r in best.collect()]


def common_words(counts: DataFrame, limit: int) -> dict[str, float]:
    """-log of the share of the commonest words, in three labelled rows at least."""
    best = counts.where("feature like '=%'").orderBy(F.desc("n"), "feature").limit(limit).collect()
    total = sum(r["n"] for r in best)
    return {r["feature"][1:]: math.log(total / r["n"]) for r in best}


def _rated(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model, weights, bias, lexicon = sent.value
    reader = Reader(model, weights, lexicon=lexicon)
    for batch in batches:
        for part in row_chunks(batch, "bytes", 1 << 22):
            found = [sorted(reader.read(x.as_py().decode())) for x in part.column("bytes")]
            z = [max(-500.0, min(500.0, bias + sum(weights[f] for f in fs))) for fs in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([1 / (1 + math.exp(-v)) for v in z]), pa.array(found, pa.list_(pa.string()))], ["doc_id", "score", "evidence"])


def _clean(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model, weights, bias, lexicon = sent.value
    reader = Reader(model, weights, lexicon=lexicon)
    for batch in batches:
        for part in row_chunks(batch, "bytes", 1 << 22):
            keep = [bias + sum(weights[f] for f in sorted(reader.read(x.as_py().decode()))) < 0 for x in part.column("bytes")]
            yield part.select(["row"]).filter(pa.array(keep, pa.bool_()))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classifier(docs: DataFrame, labels: DataFrame):
    """The broadcast character model, weights by feature, bias and lexicon, learnt as ``toxicity`` says."""
    context = docs.sparkSession.sparkContext
    model = character_model(docs).tolist()
    sent = context.broadcast(model)
    usable = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # one row for each id
    shown = docs.select("doc_id", whole_text().alias("bytes")).join(picked, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("bytes").alias("bytes"))
    rows = shown.select("toxic", "bytes").mapInArrow(lambda it: trimmed(_featured(it, sent)), "toxic int, features array<string>")
    rows = written(rows.withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    good, bad = kinds.get(0, 0), kinds.get(1, 0)
    counts = written(counted(rows))
    names = telling(counts, good, bad, FEATURES)
    weights, bias = fitted(rows, names, good, bad)
    lexicon = common_words(counts, LEXICON)
    dropped(rows, counts)
    rarest = max(lexicon.values(), default=0.0)
    lexicon = {n[1:]: rarest for n in names if n[0] == "="} | lexicon
    return context.broadcast((model, dict(zip(names, weights.tolist())), bias, lexicon))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns used: doc_id, text): doc_id, held_out, score, predicted and evidence, the
    words (with =) and word beginnings that speak for toxicity.

    ``labels`` (doc_id, toxic) are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, all of them. Of several labels of an id the largest counts, of several texts the smallest; null labels and
    ids do not. Null and empty
    texts have no words and score as the bias. Without labels of both kinds, scores are under a half. A null doc_id is not
    held out.
    """
    ready = classifier(docs, labels)
    texts = docs.select("doc_id", whole_text().alias("bytes"))
    out = texts.mapInArrow(lambda it: trimmed(_rated(it, ready)), "doc_id long, score double, evidence array<string>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under a half. See ``toxicity``."""
    ready = classifier(docs, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), whole_text().alias("bytes"))
    kept = rows.mapInArrow(lambda it: trimmed(_clean(it, ready)), StructType([StructField("row", docs.schema)]))
    return kept.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
