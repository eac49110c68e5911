"""Removal of passages that repeat anywhere in the corpus, by repeated-phrase automata.

A passage repeats where a window of 35 words occurs at two places. Every window holds
a 12-word phrase that its words alone select (the least hash of its 24 phrases), so
equal windows select equal phrases, and a corpus has one selected phrase for about
each 12 words.

1. Selected phrases that occur at two places, counted by hash, are the recurring ones.
   A different text counts once whatever its copies: a text that several rows hold is
   repeated as a whole, and one row stands for it in what follows.
2. The recurring phrases are compiled into sharded Aho-Corasick automata, and every
   text with any of them is streamed through its shards' automata, which confirms the
   phrases word by word and gives the place of every occurrence. A phrase's shard is
   that of the least text that holds it, so what copies of a text share lies in few
   shards and a text visits few; a text with very many phrases has several.
3. The windows whose selected phrase is confirmed are counted by a hash of all their
   35 words together with the phrase's; those at two places are repeated.
4. The words that repeated windows cover are removed, in one pass over all documents.

Nothing is capped: phrases and windows are counted with sums before the shuffle, so a
passage in a third of all documents costs a row for each task, and a shard has a
bounded number of phrases however many shards there are.

Defined cases: null and wordless texts have no words and keep the empty text; texts
shorter than a window lose nothing; repeated rows are copies of each other; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, filesystem, keyed, pieces, raw, release, representatives, saved, scratch, texts_of
from vecspark.llm._shared import remove as remove_folder
from vecspark.llm._words import chunks, rolling, signed, within, word_hashes

WINDOW, PHRASE = 35, 12
#: Phrases of one automaton; some 25 MB of nodes for each 10,000.
SHARD_PHRASES = 20_000
#: Texts that one task streams through a shard's automaton, about.
TASK_TEXTS = 2_000
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` consecutive hashes, the first of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(h)), 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at = np.where(h[b] < h[a], b, a)
        size *= 2
    a, b = at[:n], at[width - size : width - size + n]
    return np.where(h[b] < h[a], b, a)


def selected(words: list[bytes], window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, phrase hashes, and the place of each window's selected phrase."""
    w = word_hashes(words)
    h = rolling(w, phrase)
    return w, h, _least(h, window - phrase + 1)


def _texts(batch: pa.RecordBatch, column: int) -> list[list[bytes]]:
    return [t.split() for t in raw(batch.column(column))]


def _flat(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts together: phrase hashes, window starts, their texts, their selected phrases."""
    counts = np.array([len(w) for w in texts], np.int64)
    w, h, at = selected([x for t in texts for x in t])
    starts, docs = within(counts, WINDOW)
    return w, h, starts, np.stack([docs, at[starts]]) if len(starts) else np.zeros((2, 0), np.int64)


def phrase_rows(kd: DataFrame) -> DataFrame:
    """(phrase, tk, t, n): the selected phrases of each row's text, and their occurrences in it.

    t is half of the text's digest, enough to tell two texts of a phrase apart.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, seen = [], set()
        tk, texts = batch.column(1).to_pylist(), raw(batch.column(0))
        first = [i for i, k in enumerate(tk) if not (k in seen or seen.add(k))]
        for a, b in chunks([len(texts[i]) for i in first], 4_000_000):
            some = first[a:b]
            _, h, _, (docs, at) = _flat([texts[i].split() for i in some])
            if not len(at):
                continue
            new = np.concatenate([[True], (at[1:] != at[:-1])])  # windows in order share a selected place
            docs, at = docs[new], at[new]
            places = np.unique(np.stack([docs, at], 1), axis=0)
            docs, e = places[:, 0], h[places[:, 1]]
            order = np.lexsort((e, docs))
            docs, e = docs[order], e[order]
            start = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (e[1:] != e[:-1])]))
            n = np.diff(np.append(start, len(e)))
            out.append((signed(e[start]), np.array(some)[docs[start]], n.astype(np.int32)))
        if not out:
            return None
        e, rows, n = (np.concatenate(x) for x in zip(*out))
        t = np.array([int.from_bytes(k[:8], "little", signed=True) for k in tk], np.int64)
        return pa.record_batch([pa.array(e), batch.column(1).take(pa.array(rows)), pa.array(t[rows]), pa.array(n)], names=["phrase", "tk", "t", "n"])

    return arrow_map(kd.select("text", "tk"), run, "phrase long, tk binary, t long, n int")


def phrase_texts(needed: DataFrame) -> DataFrame:
    """(shard, words): the recurring phrases of each text, spelled out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got: dict[tuple[int, int], bytes] = {}
        for words, pairs in zip(_texts(batch, 0), batch.column(1).to_pylist()):
            _, h, at = selected(words)
            e, shard = signed(h), {p["phrase"]: p["shard"] for p in pairs}
            for i in np.unique(at).tolist():
                if (key := int(e[i])) in shard:
                    got[shard[key], key] = b" ".join(words[i : i + PHRASE])
        return pa.record_batch([pa.array([s for s, _ in got], pa.int32()), pa.array(list(got.values()), pa.binary())], names=["shard", "words"])

    return arrow_map(needed.select("text", "phrases"), run, "shard int, words binary")


class Automata:
    """The automaton of one shard at a time, built from its file in the shared folder."""

    def __init__(self, folder: str):
        self.folder, self.shard, self.automaton = folder, None, None

    def get(self, shard: int) -> ahocorasick.Automaton | None:
        if shard != self.shard:
            fs, path = filesystem(f"{self.folder}/shard={shard}")
            table = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["words"])
            a = ahocorasick.Automaton()
            for words in table.column(0).to_pylist():
                a.add_word(" " + words.decode("latin-1") + " ", True)
            if len(a):
                a.make_automaton()
            self.shard, self.automaton = shard, a if len(a) else None
        return self.automaton


def occurrences(needed: DataFrame, folder: str, shards: int) -> DataFrame:
    """(tk, places): word places of every occurrence of a shard's phrases in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(folder)
        for batch in (x for b in batches for x in pieces(b)):
            out = []
            for shard, words in zip(batch.column(0).to_pylist(), _texts(batch, 2)):
                a = automata.get(shard)
                line = " " + b" ".join(words).decode("latin-1") + " "
                ends = np.cumsum([len(w) + 1 for w in words])
                found = np.array([end for end, _ in a.iter(line)], np.int64) if a else np.zeros(0, np.int64)
                out.append((np.searchsorted(ends, found) - PHRASE + 1).tolist())
            yield pa.record_batch([batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["tk", "places"])

    at = F.explode(F.array_distinct(F.transform("phrases", lambda x: F.struct(x["shard"].alias("shard"), x["tasks"].alias("tasks"))))).alias("at")
    rows = needed.select("tk", "text", at).select("tk", "text", "at.shard", F.pmod(F.xxhash64("tk"), F.col("at.tasks")).alias("task"))
    # The texts of a shard go to one task, those of a phrase of very many texts to many.
    spread = rows.repartition("shard", "task")
    return spread.sortWithinPartitions("shard").select("shard", "tk", "text").mapInArrow(run, "tk binary, places array<int>")


def window_rows(texts: DataFrame) -> DataFrame:
    """(phrase, window, tk, place) of the windows whose selected phrase is confirmed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for i, (words, places) in enumerate(zip(_texts(batch, 1), batch.column(2).to_pylist())):
            if len(words) < WINDOW:
                continue
            w, h, at = selected(words)
            here = np.zeros(len(h), bool)
            here[np.array(places, np.int64)] = True
            on = np.flatnonzero(here[at])
            if len(on):
                out.append((signed(h[at[on]]), signed(rolling(w, WINDOW)[on]), np.full(len(on), i), on.astype(np.int32)))
        if not out:
            return None
        e, r, rows, on = (np.concatenate(x) for x in zip(*out))
        return pa.record_batch([pa.array(e), pa.array(r), batch.column(0).take(pa.array(rows)), pa.array(on)], names=["phrase", "window", "tk", "place"])

    return arrow_map(texts.select("tk", "text", "places"), run, "phrase long, window long, tk binary, place int")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and saved (tk, copies, places): where repeated windows start in each text that has any."""
    spark = docs.sparkSession
    kd = keyed(docs, id_col, text_col)
    reps = saved(representatives(kd), "texts")
    phrases = saved(phrase_rows(kd), "phrases")
    counts = phrases.groupBy("phrase").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
    recurring = saved(counts.filter("a <> b OR n > 1").select("phrase", "a", "c"), "recurring")
    total = recurring.count()
    shards = max(1, -(-2 * total // SHARD_PHRASES))
    # A text that stands first for very many phrases has so many shards that each holds few of them.
    split = F.ceil(F.col("k") * 4 / SHARD_PHRASES)
    shard = F.pmod(F.xxhash64("a", F.pmod("phrase", split)), F.lit(shards)).cast("int")
    first = recurring.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.ceil(F.max("c") / TASK_TEXTS).alias("tasks"))
    of_phrase = recurring.join(first, "a").select("phrase", shard.alias("shard"), "tasks")
    of_text = phrases.select("phrase", "tk").join(of_phrase, "phrase").groupBy("tk").agg(F.collect_set(F.struct("phrase", "shard", "tasks")).alias("phrases"))
    of_text = saved(of_text, "phrases-of")
    release(phrases, recurring)
    texts = texts_of(kd, reps.join(of_text.select("tk"), "tk").select("tk", "rep_id"))
    needed = saved(texts.join(of_text, "tk"), "needed")
    release(of_text)
    folder = scratch(spark, "shards")
    phrase_texts(needed).distinct().repartition(min(shards, 2000), "shard").write.partitionBy("shard").parquet(folder)
    places = occurrences(needed, folder, shards).groupBy("tk").agg(F.flatten(F.collect_list("places")).alias("places"))
    windows = saved(window_rows(needed.select("tk", "text").join(places, "tk")), "windows")
    release(needed)
    remove_folder(folder)
    twice = windows.groupBy("phrase", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("phrase", "window")
    twice = saved(twice, "twice")  # a plain table beside windows: Spark can split a hot window's join
    marks = windows.join(twice, ["phrase", "window"]).groupBy("tk").agg(F.collect_list("place").alias("places"))
    copies = reps.filter("copies > 1").select("tk", "copies")
    marks = saved(marks.join(copies, "tk", "full").select("tk", "copies", "places"), "marks")
    release(windows, twice, reps)
    return kd, marks


def kept_words(words: list[bytes], copied: bool, places: list[int] | None) -> list[bytes]:
    """The words no repeated window covers."""
    if len(words) < WINDOW or not (copied or places):
        return words
    if copied:
        return []
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(places, np.int64))
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    on = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(on)]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT columns and `kept` (the kept words, joined by blanks) of each document."""
    kd, marks = repeated(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, n = [], []
        for words, copies, places in zip(_texts(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            n.append(len(words))
            kept.append(kept_words(words, copies is not None, places))
        lines = [b" ".join(k) for k in kept]
        columns = [
            batch.column(0),
            pa.array(n, pa.int64()),
            pa.array([a - len(k) for a, k in zip(n, kept)], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in lines], pa.string()),
            pa.array(lines, pa.binary()).cast(pa.string()),
        ]
        return pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = kd.join(marks, "tk", "left").select(F.col("id").cast("long"), "text", "copies", "places")
    return arrow_map(rows, run, RESULT + ", kept string")


#: The same in SQL, over windows as lists of words.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS g FROM d WHERE len(w) >= 35),
r AS (SELECT g FROM o GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM o JOIN r USING (g)),
x AS (SELECT rid, count(*) AS n, list(j) AS js FROM c GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN x.n IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(array_to_string(list_filter(d.w, lambda v, k: NOT list_contains(x.js, k)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN x USING (rid)
"""
