"""Spelling variants: words of a corpus that differ by one code point, found with forward and backward minimal acyclic automata.

1. Tasks count the words of their texts before the shuffle; what stays is a vocabulary with a count for each word.
2. One inserted, deleted or replaced code point lies in one half of a word, so the other half stands unchanged in the near word: the first half at its start or the second at its
   end. Words are dealt by these halves (each word as a query by its own length, and as an entry for queries one shorter, as long and one longer). A group of more than HOT words whose
   open part has more than two code points is dealt again by halves of that part, so no half that very many words share lands in one task.
3. A task builds a minimal acyclic automaton of its words, and one of the reversed words. Edges say how many words come before, which numbers all words (a perfect hash). A query walks
   its exact half, then completes with one error; the number of the state it ends in is the near word.
4. Pairs that were found in both directions are made distinct, shuffled once by word, and give each word's near words and form.
5. Forms have at least twice the count of their word, so chains are short; roots follow by pointer doubling in a few joins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_of, unstage
from .words import runs

#: Production parameters: letters of a run, code points and occurrences of a word at least, how many times its word's count a form has at least.
LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES = "A-Za-zÀ-ÿ", 5, 3, 2
#: Words that a task counts before it hands them on; code points of a task's words; words of a group that is dealt again.
COUNTS, SHARD, HOT = 300_000, 400_000, 20_000
_RUN, _GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspell(key: str, run: str, every: int = 97) -> str:
    """The run less one code point for one in every so many pairs of key and run, as the contract asks for; every = 0 leaves all."""
    if every:
        h = zlib.crc32(f"{key}:{run}".encode("utf-8", "surrogatepass"))
        if h % every == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def vocabulary(docs: DataFrame, every: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences. every: see misspell."""

    def run(batches):
        found: Counter[str] = Counter()
        flush = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
        for b in slices(batches):
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own: Counter[str] = Counter()
                for words in runs(t.as_py(), _RUN, _GAP):
                    for w, n in Counter(words).items():
                        own[w.lower() if w.isascii() else w.translate(_LOW)] += n
                for w, n in own.items():
                    w = misspell(k, w, every)
                    if len(w) >= LEAST_LENGTH:
                        found[w] += n
                if len(found) > COUNTS:
                    yield flush(found)
                    found.clear()
        yield flush(found)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words. A word's number is its place among them: the sum of what its edges skip."""

    def __init__(self, words: list[str]):
        edges: list[dict[str, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # states of the last word that may still change
        free: list[int] = []

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, c, state = path.pop()
                sign = (final[state], *edges[state].items())
                if (same := known.setdefault(sign, state)) != state:
                    edges[parent][c] = same
                    edges[state] = {}
                    free.append(state)

        last = ""
        for w in words:
            k = 0
            while k < len(path) and k < len(w) and w[k] == last[k]:
                k += 1
            settle(k)
            state = path[-1][2] if path else 0
            for c in w[k:]:
                if free:
                    new = free.pop()
                    final[new] = False
                else:
                    new = len(final)
                    edges.append({})
                    final.append(False)
                edges[state][c] = new
                path.append((state, c, new))
                state = new
            final[state] = True
            last = w
        settle(0)
        self.final = final
        self.edges = self._numbered(edges)

    def _numbered(self, edges: list[dict[str, int]]) -> list[dict[str, tuple[int, int]]]:
        """Edges with their target and how many words of the state come before."""
        size = [-1] * len(edges)
        out: list[dict[str, tuple[int, int]]] = [{} for _ in edges]
        todo = [0]
        while todo:
            s = todo[-1]
            if size[s] >= 0:
                todo.pop()
            elif waits := [t for t in edges[s].values() if size[t] < 0]:
                todo += waits
            else:
                n = int(self.final[s])
                for c, t in sorted(edges[s].items()):
                    out[s][c] = (t, n)
                    n += size[t]
                size[s] = n
                todo.pop()
        return out

    def exact(self, word: str, at: int = 0, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        """(state, number) after the letters of word from at on."""
        edges = self.edges
        for c in word[at:] if at else word:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with the first half letters of word and differ from it by exactly one letter behind them."""
        out: set[int] = set()
        start = self.exact(word[:half])
        if start is None:
            return out

        def ends(at: int, state: int, number: int) -> None:
            got = self.exact(word, at, state, number)
            if got and self.final[got[0]]:
                out.add(got[1])

        state, number = start
        for at in range(half, len(word) + 1):
            c = word[at] if at < len(word) else None
            before = word[at - 1] if at > half else None
            for x, (to, skip) in self.edges[state].items():
                if x != before:  # one more of a letter counts where the letter's run begins
                    ends(at, to, number + skip)
                if c is not None and x != c:
                    ends(at + 1, to, number + skip)
            if c is None:
                break
            if c != before:
                ends(at + 1, state, number)
            step = self.edges[state].get(c)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return out


def _refined(e: DataFrame) -> DataFrame:
    """Entries (word, n, size, pre, suf) twice: with the first and with the second half of the open part closed. size: code points of the queries of an entry's group."""
    open_ = F.col("size") - F.col("pre") - F.col("suf")
    first = F.floor(open_ / 2).cast("int")
    sides = F.array(F.struct(F.lit(False).alias("back"), (F.col("pre") + first).alias("pre"), F.col("suf").alias("suf")), F.struct(F.lit(True).alias("back"), F.col("pre").alias("pre"), (F.col("suf") + open_ - first).alias("suf")))
    e = e.select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.*")
    ends = F.left("word", F.col("pre")), F.when(F.col("suf") > 0, F.right("word", F.col("suf"))).otherwise("")
    return e.withColumn("grp", F.xxhash64("size", "back", "pre", "suf", *ends))


def entries(words: DataFrame) -> DataFrame:
    """(word, n, size, back, pre, suf, grp): the groups in which words can be near, groups of one word left out."""
    zero = F.lit(0)
    sized = words.select("word", "n", F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("size"), zero.alias("pre"), zero.alias("suf"))
    todo, done = sized.where(F.col("size") >= 0), None
    while True:
        e = stage(_refined(todo))
        own = F.count(F.when(F.length("word") == F.col("size"), 1))
        group = e.groupBy("grp").agg(F.count("*").alias("c"), own.alias("own"), F.max(F.col("size") - F.col("pre") - F.col("suf")).alias("open")).where("c > 1 and own > 0")
        group = stage(group.select("grp", ((F.col("c") > HOT) & (F.col("open") > 2)).alias("hot")))
        e = e.join(group, "grp")
        flat = e.where("not hot").drop("hot")
        done = flat if done is None else done.unionAll(flat)
        if not group.where("hot").take(1):
            return done
        todo = e.where("hot").select("word", "n", "size", "pre", "suf")


def _matched(part: pa.Table) -> pa.Table:
    """(word, near, near_n) of a shard."""
    rows = part.to_pylist()
    count = {r["word"]: r["n"] for r in rows}
    found: set[tuple[str, str]] = set()
    for back in (False, True):
        own = [r for r in rows if r["back"] == back]
        turn = (lambda w: w[::-1]) if back else (lambda w: w)
        words = sorted({turn(r["word"]) for r in own})
        a = Automaton(words)
        for r in own:
            if len(w := r["word"]) == r["size"]:
                found.update((w, turn(words[k])) for k in a.near(turn(w), r["suf" if back else "pre"]))
    w, near = [x for x, _ in found], [x for _, x in found]
    return pa.table({"word": pa.array(w, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array([count[x] for x in near], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every word with each word that differs by exactly one code point, partitioned by word. words: distinct word, n."""
    e = stage(entries(words))
    total = e.agg(F.sum(F.length("word")).alias("n")).first().n or 0
    shard = F.pmod(F.col("grp"), F.lit(max(1, -(-total // SHARD)))).alias("shard")
    found = e.select("word", "n", "size", "back", "pre", "suf", shard).groupBy("shard").applyInArrow(_matched, "word string, near string, near_n long")
    return found.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form): the last of the chain of forms."""
    r = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while True:
        to = r.select(F.col("word").alias("root"), F.col("root").alias("next"))
        j = stage(r.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        unstage(r)
        r = j
        if not r.where("moved").take(1):
            return r.drop("moved")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word of words (distinct word, n): word, form, root, n, n_near, form_n.

    form is the near word with the largest n (ties: the smallest in code-point order) if that is at least times the word's own n, else null; root is the last word of its chain of forms, the
    word itself without a form. No words give no rows; null words are left out.
    """
    words = stage(words.where("word is not null").select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    fits = -F.col("b.less") >= times * F.col("n")
    w = stage(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.less")).alias("form_n")))
    root = roots(w.where("form is not null").select("word", "form"))
    return w.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, every: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """variants() of the words of all texts. Null texts have no words; repeated rows count as often as they are there; a null key counts as the empty text; other columns are not read."""
    return variants(vocabulary(docs, every, key, text))
