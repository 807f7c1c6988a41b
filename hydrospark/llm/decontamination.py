"""Benchmark decontamination with a generalised suffix automaton.

All test items go into one automaton over words.  Every document streams through it;
the longest match that ends at each word is tracked, and where it reaches a window
(13 words, or a whole shorter item) the words of that window are hit.  Spans of hit
words are removed where they pass the length limit, and all spans from documents that pass the coverage limit.

Only stretches in which every neighbouring pair of words occurs in some item can hold
a match of two words or more, so the automaton is stepped through those alone; the
rest of a text would only throw it back to its start.

Scale: one narrow pass over the texts, nothing is shuffled.  The items are sent to the
executors in automata of at most ``ITEM_WORDS`` words each, one broadcast for each, and the
driver builds one at a time; a larger benchmark becomes several automata, applied one after
another, in the pipeline's stage as in the report.

Defined results: null texts and items have no words; items with equal ids count once; an
item without an id hits words like any other but is neither counted in ``n_items`` nor named;
repeated rows are judged row by row; empty tables give empty results or no hits; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrospark.llm.common import aside, stored, table

WINDOW = 13
#: A document is contaminated if it has a hit and one word in this many, or more, is hit.
COVERAGE = 20
#: Spans of so many hit words, or more, are cut from any document.
LONG_SPAN = 20
#: Words of test items in one automaton (about 300 bytes each when built).
ITEM_WORDS = 250_000
#: Columns of a scan.
MADE = ("__spans", "__items", "__n")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of digits, letters and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.ids: dict[bytes, int] = {}
        coded = [(i, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for i, ws in items if ws]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        states = len(self.len)
        self.whole: list[frozenset] = [frozenset()] * states  # items that hold the state's 13-word window
        self.short: list[tuple] = [()] * states  # (words, item) of shorter items that end here
        whole: dict[int, set] = {}
        short: dict[int, set] = {}
        for item, seq in coded:
            state = length = 0
            for k, c in enumerate(seq):
                state, length = self.step(state, length, c)
                if k + 1 >= WINDOW:
                    whole.setdefault(self._at(state, WINDOW), set()).add(item)
            if len(seq) < WINDOW:
                short.setdefault(self._at(state, len(seq)), set()).add((len(seq), item))
        for s in sorted(range(states), key=self.len.__getitem__):
            up = self.link[s]
            if s in whole:
                self.whole[s] = frozenset(whole[s])
            elif up > 0 and self.len[up] >= WINDOW:
                self.whole[s] = self.whole[up]
            self.short[s] = (self.short[up] if up > 0 else ()) + tuple(short.get(s, ()))
        self.single = {seq[0] for _, seq in coded if len(seq) == 1}
        n = len(self.ids)
        self.pairs = np.unique(np.array([a * n + b for _, seq in coded for a, b in zip(seq, seq[1:])], np.int64))
        self.least = min((min(len(seq), WINDOW) for _, seq in coded if len(seq) > 1), default=0)

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._new(self.len[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _new(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(0)
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.len[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _at(self, state: int, length: int) -> int:
        """The state on the suffix path whose strings include the suffix of that many words."""
        while self.len[self.link[state]] >= length and state > 0:
            state = self.link[state]
        return state

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The longest suffix of what was read that occurs in an item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit stretches (first word, one past the last) and the items whose windows occur."""
        get = self.ids.get
        code = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set = set()
        if self.single:
            for i in np.flatnonzero(np.isin(code, list(self.single))):
                spans.append((int(i), int(i) + 1))
                items |= {item for size, item in self.short[self.next[0][int(code[i])]] if size == 1}
        if self.least and len(code) >= self.least:
            near = (code[:-1] >= 0) & (code[1:] >= 0)
            at = np.flatnonzero(near)
            if len(at):
                pair = code[at] * len(self.ids) + code[at + 1]
                where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                near[at] = self.pairs[where] == pair
                edge = np.diff(np.concatenate(([0], near.view(np.int8), [0])))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    if b - a + 1 >= self.least:
                        self._stream(code[a : b + 1].tolist(), int(a), spans, items)
        return spans, items

    def _stream(self, run: list[int], base: int, spans: list, items: set) -> None:
        state = length = 0
        for i, c in enumerate(run, base):
            state, length = self.step(state, length, c)
            if length >= WINDOW:
                spans.append((i + 1 - WINDOW, i + 1))
                items |= self.whole[state]
            for size, item in self.short[state]:
                if size <= length:
                    spans.append((i + 1 - size, i + 1))
                    items.add(item)


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching stretches joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(benchmark: DataFrame):
    """Automata of all items, each of about ITEM_WORDS words; the driver holds one group of items at a time."""
    group: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null").toLocalIterator():
        words = words_of(row["t"])
        if group and size + len(words) > ITEM_WORDS:
            yield Automaton(group)
            group, size = [], 0
        if len(words) > ITEM_WORDS:  # cut, with a window's overlap, so that no window is lost
            step = max(ITEM_WORDS - WINDOW, WINDOW)
            for k in range(0, len(words) - WINDOW + 1, step):
                yield Automaton([(row["i"], words[k : k + step + WINDOW - 1])])
            continue
        group.append((row["i"], words))
        size += len(words)
    yield Automaton(group)


def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (which must have ``text``) with ``__spans, __items, __n``: hit stretches of words, item ids, number of words.

    Columns of those names in ``docs`` are replaced.
    """
    docs = docs.drop(*MADE)
    out = docs.withColumns({"__spans": F.expr("cast(array() as array<int>)"), "__items": F.expr("cast(array() as array<string>)"), "__n": F.lit(0).cast("long")})
    for automaton in automata(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches, sent=sent):
            found = sent.value
            for b in batches:
                flat, names, n = [], [], []
                for text, old, had in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), b.column("__items").to_pylist()):
                    words = words_of(text)
                    spans, items = found.scan(words)
                    flat.append([x for s in merged([*zip(old[::2], old[1::2]), *spans]) for x in s])
                    names.append(sorted({*had, *items} - {None}))
                    n.append(len(words))
                rest = [c for c in b.schema.names if c not in MADE]
                yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(flat, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string())), pa.array(n, pa.int64())], names=[*rest, *MADE])

        out = out.mapInArrow(run, out.schema)
    return out


def judged(spans: list[int], n_words: int) -> tuple[int, bool]:
    n_hit = sum(b - a for a, b in zip(spans[::2], spans[1::2]))
    return n_hit, n_hit > 0 and COVERAGE * n_hit >= n_words


def to_cut(spans: list[int], n_words: int) -> list[int]:
    """The spans that go: all of a contaminated document, else those that are long by themselves."""
    if judged(spans, n_words)[1]:
        return spans
    return [x for a, b in zip(spans[::2], spans[1::2]) if b - a >= LONG_SPAN for x in (a, b)]


def remove_spans(text: str, spans: list[int]) -> str:
    """The text without the hit words and what stands between them; the blanks around a cut stay once."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit spans cut out of contaminated documents, and those of ``LONG_SPAN`` words out of all, until none is left in them.

    What is below both limits stays as it is.  A document of
    which no word is left goes.  ``n_chars``, where present, follows the new text.  All are
    scanned once; those that were cut are scanned again, as a cut joins what stood around it.
    """
    docs, back = aside(docs)
    columns, done, rest = docs.columns, [], docs
    while True:
        seen = stored(_cut(scanned(rest, benchmark)), "decontaminated")
        done.append(seen.where("not __again").select(*columns))
        rest = seen.where("__again").select(*columns)
        if rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return back(out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out)


def _cut(rows: DataFrame) -> DataFrame:
    """Scanned rows with what is over a limit cut out; ``__again`` marks those that were cut and have words left."""
    schema = T.StructType([*(f for f in rows.schema if f.name not in MADE), T.StructField("__again", T.BooleanType())])

    def run(batches):
        for b in batches:
            texts, again, mask = [], [], []
            for text, spans, n in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), b.column("__n").to_pylist()):
                gone = to_cut(spans, n)
                texts.append(remove_spans(text, gone) if gone else text)
                again.append(bool(gone))
                mask.append(not gone or n > sum(gone[1::2]) - sum(gone[::2]))
            cols = [pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in b.schema.names if c not in MADE]
            made = pa.RecordBatch.from_arrays([*cols, pa.array(again, pa.bool_())], names=[*(c for c in b.schema.names if c not in MADE), "__again"])
            yield made.filter(pa.array(mask, pa.bool_()))

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, item ids, verdict and the hit stretches (word positions)."""

    def run(batches):
        for b in batches:
            items = b.column("__items").to_pylist()
            hit = [judged(s, k) for s, k in zip(b.column("__spans").to_pylist(), b.column("__n").to_pylist())]
            digest = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("__n"), pa.array([h for h, _ in hit], pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(digest, pa.string()), pa.array([c for _, c in hit], pa.bool_()), b.column("__spans")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    found = scanned(docs.select("doc_id", "text"), benchmark)
    return found.drop("text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP10_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dwin AS (
  SELECT rid, k, p, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, sizes WHERE len(w) >= k)),
hits AS (SELECT rid, d.k, p, item FROM dwin d JOIN win USING (k, s)),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
