"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of variable order, up to ``ORDER``,
counted once and then frozen. A byte's code length is that of the longest known
context in which it was seen, plus the escapes of the longer contexts in which
it wasn't (escape method C: distinct / (total + distinct)); a byte that no
context knows costs eight bits. Contexts start anew at each run of white space,
so a text's exact code length is the sum of those of its words, each coded with
the space before it as first context and the space after it as last symbol.

A text's language is that with the shortest code, ties to the first name in
order; ``score`` is its share when code lengths are turned back into
probabilities. A text that is null or has no letter is ``und`` with score 0,
as is every text when nothing was learned.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Longest context in bytes.
ORDER = 4
#: Labelled documents taken for each language (the expected number; a hash of the id chooses them).
TRAIN_DOCS = 400
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def count_contexts(words: Counter[bytes]) -> dict[bytes, dict[int, int]]:
    """Symbol counts by context, of the words of one language."""
    tree: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for word, n in words.items():
        s = b" " + word + b" "
        for i in range(1, len(s)):
            for k in range(min(ORDER, i) + 1):
                tree[s[i - k : i]][s[i]] += n
    return {c: dict(x) for c, x in tree.items()}


class Ppm:
    """Frozen code lengths of all languages.

    ``gram_row`` maps context + symbol, and ``context_row`` a context, to a row of
    ``bits``, which has a column for each language: the code length of the symbol
    with all escapes below that context, or the context's own escape.
    """

    def __init__(self, trees: dict[str, dict[bytes, dict[int, int]]]):
        self.langs = sorted(trees)
        contexts = sorted({c for t in trees.values() for c in t}, key=lambda c: (len(c), c))
        self.context_row: dict[bytes, int] = {}
        self.gram_row: dict[bytes, int] = {}
        bits: list[list[float]] = []
        for c in contexts:
            nodes = [trees[lang].get(c) for lang in self.langs]
            totals = [(sum(x.values()), len(x)) if x else (0, 0) for x in nodes]
            escape = [math.log2((n + q) / q) if q else 0.0 for n, q in totals]
            self.context_row[c] = len(bits)
            bits.append(escape)
            for symbol in sorted({s for x in nodes if x for s in x}):
                shorter = self._row(bits, c[1:] + bytes([symbol])) if c else [8.0] * len(nodes)
                self.gram_row[c + bytes([symbol])] = len(bits)
                bits.append([math.log2((n + q) / x[symbol]) if x and symbol in x else e + s for x, (n, q), e, s in zip(nodes, totals, escape, shorter, strict=True)])
        self.unknown = len(bits)
        bits.append([8.0] * len(self.langs))
        self.bits = np.array(bits, np.float64).reshape(len(bits), len(self.langs))

    def _row(self, bits: list[list[float]], gram: bytes) -> list[float]:
        return bits[self.gram_row[gram]]

    def rows(self, word: bytes) -> list[int]:
        """Rows of ``bits`` whose sum is the word's code length."""
        s, out = b" " + word + b" ", []
        grams, contexts = self.gram_row, self.context_row
        for i in range(1, len(s)):
            for a in range(max(0, i - ORDER), i + 1):
                row = grams.get(s[a : i + 1])
                if row is not None:
                    out.append(row)
                    break
                if (row := contexts.get(s[a:i])) is not None:
                    out.append(row)
            else:
                out.append(self.unknown)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits by text and language."""
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        ids, counts = [], []
        for t in texts:
            words = t.split()
            ids += map(index.__getitem__, words)
            counts.append(len(words))
        out = np.zeros((len(texts), len(self.langs)))
        if not ids:
            return out
        flat, sizes = [], []
        for w in index:
            flat += (r := self.rows(w))
            sizes.append(len(r))
        by_word = np.add.reduceat(self.bits[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        counts_array = np.array(counts)
        full = counts_array > 0
        starts = (np.cumsum(counts_array) - counts_array)[full]
        out[full] = np.add.reduceat(by_word[ids], starts)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and bits a byte of the best language."""
        raw = [(t or "").encode() for t in texts]
        out: tuple[list, list, list] = ([], [], [])
        if not self.langs:
            return [UNDETERMINED] * len(raw), [0.0] * len(raw), [0.0] * len(raw)
        for t, r, bits in zip(texts, raw, self.code_lengths(raw), strict=True):
            best = int(bits.argmin())
            known = bool(t) and _LETTER.search(t) is not None
            out[0].append(self.langs[best] if known else UNDETERMINED)
            out[1].append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()) if known else 0.0)
            out[2].append(float(bits[best] / max(len(r), 1)))
        return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Ppm:
    """Learn the trees from labelled rows: about ``train_docs`` whole documents a language.

    Rows without text or language are passed over, repeated ids count once. Each
    language's tree is built in a task of its own from that bounded sample.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and id is not null")
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Ppm({})
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(shares.items()) for x in (lang, int((1 << 40) * min(1.0, train_docs / n)))])
    sample = rows.where(place < limit[F.col("lang")]).groupBy("lang", "id").agg(F.min("text").alias("text"))

    def train(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        words: Counter[bytes] = Counter()
        for t in texts["text"]:
            words.update(t.encode().split())
        return pd.DataFrame({"lang": [key[0]], "tree": [pickle.dumps(count_contexts(words))]})

    trees = {r["lang"]: pickle.loads(r["tree"]) for r in sample.select("lang", "text").groupBy("lang").applyInPandas(train, "lang string, tree binary").collect()}
    return Ppm(trees)


def predict(df: DataFrame, model: Ppm, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``lang_pred``, ``score``, ``bits_per_byte`` (of the best language; 0 for an empty text). Columns with these three names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    loaded: list[Ppm] = []
    df = df.drop("lang_pred", "score", "bits_per_byte")
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())]
    out = StructType([*df.schema.fields, *made])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(pickle.loads(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 400):
                piece = batch.slice(start, 400)
                lang, score, rate = loaded[0].predict(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=out.names)

    return df.mapInArrow(run, out)
