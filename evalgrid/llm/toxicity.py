"""Toxicity: nearest labelled examples by TF-IDF cosine over all their words, and over words that tell the label.

Two votes make a score, both of the nearest examples by exact TF-IDF cosine in a block-max index:
over the whole vocabulary of the examples with real term frequencies, and over the words and word
beginnings that depend on the label. A few offensive words hardly turn the cosine of a long text,
so the second vote is needed to find them; the calibration weighs both where a text has such
words, and elsewhere the vote by all words decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch
from .text import Windows, Words, byte_table, mix, signed, slices

#: About so many labelled texts of each class serve as examples.
EXAMPLES = 10_000
#: Bytes of the word beginnings that are features beside whole words, and the counts that make a term of its own.
BEGINNINGS, LEVELS = (5, 6, 7, 8), (1, 2, 4)
#: Least chi-square of a term against the label (one in 400,000 by chance), least examples with it.
CHI_SQUARE, TERM_EXAMPLES = 22.0, 3
#: Neighbours that vote, the weight of the prior among them, and examples in one block.
NEIGHBOURS, PRIOR, BLOCK = 15, 1.0, 16
#: Terms in one of so many examples or more are common; examples by which the others are ordered, and blocks read first.
DENSE, LEADERS, FIRST = 14, 48, 16
#: Queries at once, and what rounding to single precision may change.
QUERIES, ROUNDING = 128, 1e-4
#: Entries of examples' vectors handled at once while tables are made.
PIECE = 1 << 19
#: Keys by which near copies among the examples meet.
SKETCHES = 9
_ALNUM = byte_table("alnum")


def _split(part: pa.RecordBatch, text: int) -> Words:
    return Words(part.column(text), _ALNUM, lower=True)


def _counts(words: Words, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of times, for the distinct words and word beginnings of each text.

    ``known``: sorted hashes; others are left out, by a small table first.
    """
    row = np.repeat(np.arange(words.counts.size), words.counts)
    rows, hashes = [], []
    for size in (0, *BEGINNINGS):
        long = np.flatnonzero(words.end - words.start > size) if size else slice(None)
        h = words.hashes(size)[long]
        r = row[long]
        if known is not None:
            maybe = np.flatnonzero(_low_bits(known)[(h & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.searchsorted(known, h[maybe])
            place[place == known.size] = 0
            maybe = maybe[known[place] == h[maybe]] if known.size else maybe[:0]
            h, r = h[maybe], r[maybe]
        rows.append(r)
        hashes.append(h)
    row, term = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(row.size, bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.diff(np.append(at, row.size))


_TABLES: dict[int, np.ndarray] = {}


def _low_bits(known: np.ndarray) -> np.ndarray:
    if id(known) not in _TABLES:
        _TABLES.clear()
        table = np.zeros(1 << 16, bool)
        table[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        _TABLES[id(known)] = table
    return _TABLES[id(known)]


def _parents(known: np.ndarray):
    """(child, parent): words and beginnings among ``known`` with a shorter beginning among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = _split(part, 0)
                size = words.end - words.start
                shorter: list[tuple[np.ndarray, np.ndarray]] = []
                for length in (*BEGINNINGS, 0):
                    h = words.hashes(length)
                    ok = np.isin(h, known) & ((size > length) if length else True)
                    for parent, there in shorter:
                        both = np.unique(np.stack([h[ok & there], parent[ok & there]]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(x))) for x in both], ["child", "parent"])
                    shorter.append((h, ok))

    return run


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of all runs of five words (a text of fewer: its words as one run)."""
    words = Words(column, _ALNUM, lower=True)
    counts = words.counts
    n = np.where(counts > 0, np.maximum(counts - 4, 1), 0)
    row = np.repeat(np.arange(counts.size), n)
    at = np.arange(row.size) - (np.cumsum(n) - n)[row] + words.first[:-1][row]
    return Windows(words.hashes()).at(at, np.minimum(5, counts[row])), row


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with keys of three least hashes each over their runs; texts alike at 0.8 share one but once in 600."""
    for batch in batches:
        for part in slices(batch):
            runs, row = _runs(part.column(0))
            some = np.unique(row)
            keys = np.zeros((part.num_rows, SKETCHES), np.uint64)
            if some.size:
                cut = np.searchsorted(row, some)
                for s in range(SKETCHES):
                    least = [np.minimum.reduceat(mix(runs ^ np.uint64((3 * s + i + 1) * 0x1F83D9ABFB41BD6B & (1 << 64) - 1)), cut) for i in range(3)]
                    keys[some, s] = mix(least[0] ^ mix(least[1] ^ mix(least[2] ^ np.uint64(s))))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SKETCHES), pa.array(signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], ["text", "label", "h", "doc_id", "keys"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, label) of the rows whose text is a near copy of the other text, by their sets of runs."""
    for batch in batches:
        for part in slices(batch):
            (mine, row), (others, of) = _runs(part.column(2)), _runs(part.column(3))
            mine_cut, others_cut = (np.searchsorted(r, np.arange(part.num_rows + 1)) for r in (row, of))
            keep = np.zeros(part.num_rows, bool)
            for i in range(part.num_rows):
                x, y = np.unique(mine[mine_cut[i] : mine_cut[i + 1]]), np.unique(others[others_cut[i] : others_cut[i + 1]])
                shared = np.intersect1d(x, y, assume_unique=True).size
                keep[i] = shared >= 0.8 * (x.size + y.size - shared) - 1e-9
            yield part.select([0, 1]).filter(pa.array(keep))


def _near_copies_of_lesser(drawn: DataFrame) -> DataFrame:
    """(h, label) of the examples that are near copies of the one of least hash with one of their keys."""
    keys = drawn.select("h", "label", F.explode("keys").alias("key")).where("key != 0")
    hubs = keys.groupBy("key", "label").agg(F.min("h").alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = keys.join(hubs, ["key", "label"]).where("h != hub").select("h", "label", "hub").distinct()
    other = drawn.select(F.col("h").alias("hub"), "label", F.col("text").alias("other"))
    return pairs.join(drawn.select("h", "label", "text"), ["h", "label"]).join(other, ["hub", "label"]).select("h", "label", "text", "other").mapInArrow(_alike, "h long, label int").distinct()


class Vocabulary:
    """Terms: a word or beginning together with how often at least a text has it."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.known, base = np.unique(hashes, return_inverse=True)
        self.size = hashes.size
        self.term = {level: np.full(self.known.size, -1, np.int64) for level in LEVELS}
        for level in LEVELS:
            mine = levels == level
            self.term[level][base[mine]] = np.flatnonzero(mine)

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row and term, in order, for the terms of each text."""
        row, h, n = _counts(words, self.known)
        base = np.searchsorted(self.known, h)
        found = [(row[ok], term[base[ok]]) for level, term in self.term.items() for ok in [np.flatnonzero((n >= level) & (term[base] >= 0))]]
        row, term = np.concatenate([r for r, _ in found]), np.concatenate([t for _, t in found])
        order = np.lexsort((term, row))
        return row[order], term[order]

    def lists(self, words: Words) -> list[list[int]]:
        row, term = self.rows(words)
        cut = np.searchsorted(row, np.arange(words.counts.size + 1)).tolist()
        term = term.tolist()
        return [term[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _word_counts(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among ``known`` (sorted hashes) and number of times, in order, for the distinct known words of each text."""
    if not known.size:
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(words.counts.size), words.counts)
    distinct, which = np.unique(words.hashes(), return_inverse=True)
    place = np.searchsorted(known, distinct)
    place[place == known.size] = 0
    place = np.where(known[place] == distinct, place, -1)[which]
    ok = place >= 0
    key, n = np.unique(row[ok] * known.size + place[ok], return_counts=True)
    return key // known.size, key % known.size, n


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the smallest whole type that holds all of them; fractions as they are."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.dtype.kind in "iu" else x


def _ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` places from ``begin[i]`` on, for all i in a row."""
    out = np.repeat(begin - (np.cumsum(counts) - counts), counts)
    out += np.arange(out.size)
    return out


class BlockMaxIndex:
    """Vectors of examples: those from ``first[i]`` to ``first[i + 1]`` of ``term`` and ``number`` are of example i.

    A weight is ``number`` times ``by_term`` of its term times ``by_example`` of its example (1 where
    not given). So a posting takes a few bytes, and every worker can hold a table of its own.
    Examples alike in the common terms are put next to each other in blocks. Rare terms have
    postings; common ones have the largest weight in each block, and the block's own weights.
    ``nearest`` is exact: a query's rare postings and its block maxima bound the cosines in each
    block, the blocks of the highest bounds give the k-th best cosine so far, and only blocks whose
    bound reaches that are read. Single precision chooses blocks and candidates, with room for its
    rounding; double precision decides.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, number: np.ndarray, terms: int, by_term: np.ndarray | None = None, by_example: np.ndarray | None = None):
        self.terms, self.size = terms, first.size - 1
        self.by_term = np.ones(terms) if by_term is None else by_term
        self.by_example = np.ones(self.size) if by_example is None else by_example
        self.read = [0, 0]  # blocks read, and all blocks, over the queries so far
        self._given: tuple | None = first, _narrow(term), _narrow(number)
        self._made: tuple | None = None

    def _tables(self) -> tuple:
        """Made where they are used, from the vectors alone and in pieces; then they stand for the vectors."""
        if self._made is None:
            first, term, number = self._given
            size, blocks = self.size, max(1, -(-self.size // BLOCK))
            often = sum((np.bincount(term[low : low + PIECE], minlength=self.terms) for low in range(0, term.size, PIECE)), np.zeros(self.terms, np.int64))
            common = np.flatnonzero(often * DENSE >= max(size, 1))
            place = np.full(self.terms, -1, np.int32)
            place[common] = np.arange(common.size)
            dense = np.zeros((blocks * BLOCK, common.size), np.float32)
            own = np.zeros(size + 1, np.int64)
            own_at, own_number = np.empty(int(often[common].sum()), np.min_scalar_type(common.size)), np.empty(int(often[common].sum()), number.dtype)
            row = np.repeat(np.arange(size, dtype=np.min_scalar_type(blocks * BLOCK)), np.diff(first))
            done = 0
            for low in range(0, term.size, PIECE):
                at = place[term[low : low + PIECE]]
                here = np.flatnonzero(at >= 0)
                r, at, n = row[low + here], at[here], number[low + here]
                dense[r, at] = n * self.by_term[common[at]] * self.by_example[r]
                own_at[done : done + here.size], own_number[done : done + here.size] = at, n
                own[1:] += np.bincount(r, minlength=size)
                done += here.size
            own = np.cumsum(own)
            order = np.arange(size)
            if size > BLOCK:
                leaders = dense[np.linspace(0, size - 1, min(LEADERS, size)).astype(int)]
                alike = dense[:size] @ leaders.T
                order = np.lexsort((-alike.max(axis=1), alike.argmax(axis=1)))
            spot = np.empty(size, row.dtype)
            spot[order] = np.arange(size)
            blocked = np.empty((blocks, common.size, BLOCK), np.float32)  # a line of memory for each block and term
            for j in range(blocks):
                mine = order[j * BLOCK : (j + 1) * BLOCK]
                blocked[j, :, : mine.size], blocked[j, :, mine.size :] = dense[mine].T, 0
            del dense
            often[common] = 0
            begin = np.concatenate(([0], np.cumsum(often)))
            ids, numbers = np.empty(int(begin[-1]), row.dtype), np.empty(int(begin[-1]), number.dtype)
            low = 0
            while low < self.terms:  # terms with about PIECE postings at once
                high = max(low + 1, int(np.searchsorted(begin, begin[low] + PIECE, side="right")) - 1)
                here = np.flatnonzero((term >= low) & (term < high))
                here = here[place[term[here]] < 0]
                here = here[np.argsort(term[here], kind="stable")]
                ids[begin[low] : begin[high]], numbers[begin[low] : begin[high]] = spot[row[here]], number[here]
                low = high
            scale = np.zeros(blocks * BLOCK)
            scale[:size] = self.by_example[order]
            self._made = place, order, spot, common, blocked, blocked.max(axis=2).T.copy(), ids, numbers, begin, own, own_at, own_number, scale
            self._given = None
        return self._made

    def vectors(self, examples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``first``, ``term`` and weight of different examples."""
        if self._given is not None:
            self._tables()
        _, _, spot, common, _, _, ids, numbers, begin, own, own_at, own_number, _ = self._made
        where = np.full(spot.size + BLOCK, -1)
        where[spot[examples]] = np.arange(examples.size)
        rare = np.concatenate([np.zeros(0, np.int64), *[low + np.flatnonzero(where[ids[low : low + PIECE]] >= 0) for low in range(0, ids.size, PIECE)]])
        counts = own[examples + 1] - own[examples]
        often = _ranges(own[examples], counts)
        row = np.concatenate([where[ids[rare]], np.repeat(np.arange(examples.size), counts)])
        term = np.concatenate([np.searchsorted(begin, rare, side="right") - 1, common[own_at[often]]])
        number = np.concatenate([numbers[rare], own_number[often]])
        by = np.lexsort((term, row))
        row, term = row[by], term[by]
        return np.searchsorted(row, np.arange(examples.size + 1)), term, number[by] * self.by_term[term] * self.by_example[examples][row]

    def nearest(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the examples and cosines, best first, ties by example: the k best at least, or all that share a term."""
        place, order, _, frequent, dense, most, ids, numbers, begin, own, own_at, own_number, scale = self._tables()
        blocks, size, common = dense.shape[0], dense.shape[0] * BLOCK, dense.shape[1]
        for low in range(0, first.size - 1, QUERIES):
            cut = first[low : low + QUERIES + 1]
            t, w = term[cut[0] : cut[-1]], weight[cut[0] : cut[-1]]
            row, at = np.repeat(np.arange(cut.size - 1), np.diff(cut)), place[t]
            often = np.flatnonzero(at >= 0)
            query = np.zeros((cut.size - 1, common))
            query[row[often], at[often]] = w[often]
            short = query.astype(np.float32)
            query *= self.by_term[frequent]
            w = w * self.by_term[t]
            begins, lengths = begin[t], np.where(at < 0, begin[t + 1] - begin[t], 0)
            sums = np.empty((cut.size - 1, size))
            for i in range(cut.size - 1):
                mine = slice(cut[i] - cut[0], cut[i + 1] - cut[0])
                length = lengths[mine]
                from_ = _ranges(begins[mine], length)
                parts = np.repeat(w[mine], length)
                parts *= numbers.take(from_)
                sums[i] = np.bincount(ids.take(from_), weights=parts, minlength=size)
            sums *= scale
            bounds = sums.reshape(-1, blocks, BLOCK).max(axis=2) + (short @ most + np.float32(ROUNDING))
            least, read = np.zeros(cut.size - 1), np.zeros(bounds.shape, bool)
            whole = sums.reshape(-1, blocks, BLOCK)
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(cut.size - 1)]
            for step in (FIRST, blocks):  # the best bounds first, then every block that still can matter
                wanted = (bounds >= least[:, None]) & (bounds > ROUNDING) & ~read
                if step < blocks:
                    best = np.zeros(bounds.shape, bool)
                    np.put_along_axis(best, np.argpartition(-bounds, step, axis=1)[:, :step], True, axis=1)
                    wanted &= best
                read |= wanted
                block, which = np.nonzero(wanted.T)
                start = np.searchsorted(block, np.arange(blocks + 1))
                scores = np.empty((block.size, BLOCK), np.float32)
                for j in np.flatnonzero(np.diff(start)).tolist():
                    mine = slice(start[j], start[j + 1])
                    np.matmul(short[which[mine]], dense[j], out=scores[mine])
                scores += whole[which, block]
                by_query = np.argsort(which, kind="stable")
                cuts = np.searchsorted(which[by_query], np.arange(cut.size))
                for i in range(cut.size - 1):
                    mine = by_query[cuts[i] : cuts[i + 1]]
                    found[i].append((block[mine], scores[mine]))
                    flat = np.concatenate([x.ravel() for _, x in found[i]])
                    if flat.size > k:
                        least[i] = max(0.0, np.partition(flat, flat.size - k)[flat.size - k] - 2 * ROUNDING)
            self.read[0] += int(read.sum())
            self.read[1] += read.size
            for i in range(cut.size - 1):
                flat, mine = np.concatenate([x.ravel() for _, x in found[i]]), np.concatenate([b for b, _ in found[i]])
                near = np.flatnonzero((flat > 0) & (flat >= least[i]))
                near = mine[near // BLOCK] * BLOCK + near % BLOCK
                cosine, near = sums[i, near], order[near]
                counts = own[near + 1] - own[near]
                theirs = _ranges(own[near], counts)
                cosine += np.bincount(np.repeat(np.arange(near.size), counts), weights=own_number[theirs] * query[i, own_at[theirs]], minlength=near.size) * self.by_example[near]
                best = np.lexsort((near, -cosine))
                yield near[best], cosine[best]


def _shares(found: np.ndarray, cosine: np.ndarray, pos: np.ndarray, neg: np.ndarray, factor: tuple[float, float], base: float) -> float:
    """Votes of the first NEIGHBOURS labelled texts weighted by squared cosine, with the prior."""
    n = pos + neg
    left = np.clip(NEIGHBOURS - (np.cumsum(n) - n), 0, None)
    share = np.minimum(n, left) / np.maximum(n, 1e-9) * cosine**2
    yes, no = share @ pos * factor[1], share @ neg * factor[0]
    prior = PRIOR * max(factor)
    return float((yes + prior * base) / (yes + no + prior))


class Cues:
    """Examples grouped by equal vectors of the terms that depend on the label, and their index."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, examples: list[tuple[list[int], int, int]], factor: tuple[float, float]):
        self.vocabulary, self.idf, self.factor = vocabulary, idf, factor
        self.terms = [np.array(v, np.int64) for v, _, _ in examples]
        self.pos, self.neg = np.array([p for _, p, _ in examples], float), np.array([n for _, _, n in examples], float)
        first = np.concatenate(([0], np.cumsum([v.size for v in self.terms], dtype=np.int64)))
        flat = np.concatenate([np.zeros(0, np.int64), *self.terms])
        length = np.array([np.sqrt(idf[v] @ idf[v]) for v in self.terms])
        self.index = BlockMaxIndex(first, flat, np.ones(flat.size, np.int64), vocabulary.size, idf, np.divide(1, length, out=np.zeros(length.size), where=length > 0))
        none = [i for i, v in enumerate(self.terms) if not v.size]
        pos, neg = self.pos[none].sum() * factor[1], self.neg[none].sum() * factor[0]
        self.base = float((pos + 0.5) / (pos + neg + 1))

    def weigh(self, terms: np.ndarray) -> np.ndarray:
        """TF-IDF of unit length; the levels of a term stand for its frequency."""
        w = self.idf[terms]
        return w / np.sqrt(w @ w) if w.size else w

    def votes(self, queries: list[np.ndarray], but: list[tuple[int, bool]] | None = None) -> np.ndarray:
        """``but``: for each query the vector and label of one example that is left out."""
        out = np.full(len(queries), self.base)
        some = [i for i, terms in enumerate(queries) if terms.size]
        if not some:
            return out
        first = np.concatenate(([0], np.cumsum([queries[i].size for i in some], dtype=np.int64)))
        flat, weight = np.concatenate([queries[i] for i in some]), np.concatenate([self.weigh(queries[i]) for i in some])
        for i, (found, cosine) in zip(some, self.index.nearest(first, flat, weight, NEIGHBOURS + 1), strict=True):
            pos, neg = self.pos[found], self.neg[found]
            if but:
                (pos if but[i][1] else neg)[found == but[i][0]] -= 1
            out[i] = _shares(found, cosine, pos, neg, self.factor, self.base)
        return out


class Model:
    """Examples grouped by equal words, their index over all words, the cues, and the calibration of the two votes.

    ``known``: sorted hashes of all words of the examples; those from ``first[i]`` to ``first[i + 1]``
    of ``term`` are the words of group i, each ``n`` times. ``ids``: the least doc_id of each group
    (-1: null). ``factor``: labelled texts for each example of a class, negative and positive.
    ``cue``: each group's place among those of ``cues``.
    """

    def __init__(self, known: np.ndarray, idf: np.ndarray, first: np.ndarray, term: np.ndarray, n: np.ndarray, pos: np.ndarray, neg: np.ndarray, ids: np.ndarray, factor: tuple[float, float], cues: Cues, cue: np.ndarray):
        self.known, self.idf, self.pos, self.neg, self.ids, self.factor, self.cues, self.cue = known, idf, pos, neg, ids, factor, cues, cue
        length = np.zeros(first.size - 1)
        for i in range(0, first.size - 1, 512):  # in pieces, to need little beside the result
            cut = first[i : i + 513]
            length[i : i + 512] = self.length(cut - cut[0], n[cut[0] : cut[-1]] * idf[term[cut[0] : cut[-1]]])
        self.index = BlockMaxIndex(first, term, n, known.size, idf, np.divide(1, length, out=np.zeros(length.size), where=length > 0))
        yes, no = pos.sum() * factor[1], neg.sum() * factor[0]
        self.base = float(yes / (yes + no)) if yes + no else 0.5
        self.line = np.array([0.0, 0.5, 0.5, 0.0, 1.0])

    def weigh(self, first: np.ndarray, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        """TF-IDF of unit length: times a word occurs, by its inverse document frequency."""
        w = n * self.idf[term]
        return w / np.repeat(self.length(first, w), np.diff(first))

    @staticmethod
    def length(first: np.ndarray, w: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(first.size - 1), np.diff(first))
        return np.sqrt(np.bincount(row, weights=w * w, minlength=first.size - 1))

    def votes(self, words: Words) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """For each text the vote by all words, and the nearest groups with their cosines."""
        row, term, n = _word_counts(words, self.known)
        first = np.searchsorted(row, np.arange(words.counts.size + 1))
        for found, cosine in self.index.nearest(first, term, self.weigh(first, term, n), NEIGHBOURS):
            yield _shares(found, cosine, self.pos[found], self.neg[found], self.factor, self.base), list(zip(found[:3].tolist(), cosine[:3].tolist(), strict=True))

    def others(self, groups: np.ndarray) -> np.ndarray:
        """Columns: both votes that an example of each of the groups gets from all others, whether it has cues, its label, and the labelled texts it stands for."""
        near = self.index.nearest(*self.index.vectors(groups), NEIGHBOURS + 1)
        words, queries, but, weights = [], [], [], []
        for g, (found, cosine) in zip(groups.tolist(), near, strict=True):
            for positive, n in ((True, self.pos[g] * self.factor[1]), (False, self.neg[g] * self.factor[0])):
                if n > 0:
                    pos, neg = self.pos[found], self.neg[found]
                    (pos if positive else neg)[found == g] -= 1
                    words.append(_shares(found, cosine, pos, neg, self.factor, self.base))
                    queries.append(self.cues.terms[self.cue[g]])
                    but.append((int(self.cue[g]), positive))
                    weights.append(n)
        has = np.array([q.size > 0 for q in queries], float)
        return np.stack([np.array(words), self.cues.votes(queries, but), has, np.array([float(y) for _, y in but]), np.array(weights)])

    @staticmethod
    def _planes(words: np.ndarray, cues: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Columns of the calibration: constant and votes of texts with cues, then constant and vote of those without."""
        c = has.astype(float)
        return np.stack([c, c * _logit(words), c * _logit(cues), 1 - c, (1 - c) * _logit(words)], axis=1)

    def calibrate(self, words: np.ndarray, cues: np.ndarray, has: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Logistic planes through the votes of ``others``, classes weighted as they are; every vote counts a little."""
        if not y.size or y.min() == y.max():
            return
        x, w, vote = self._planes(words, cues, has), w / w.sum() * y.size, np.array([False, True, True, False, True])
        line = self.line

        def loss(b: np.ndarray) -> float:
            z = x @ b
            return float(w @ (np.logaddexp(0, z) - y * z) + 0.005 * ((b - self.line) ** 2).sum())

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ line, -500, 500)))
            g = x.T @ (w * (y - p)) - 0.01 * (line - self.line)
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(line.size)
            free = ~vote | (line > 0.05) | (g > 0)
            step = np.zeros(line.size)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            for _ in range(40):  # a whole step can lead away
                new = np.where(vote, np.maximum(line + step, 0.05), line + step)
                if loss(new) <= loss(line):
                    break
                step /= 2
            else:
                break
            done, line = np.abs(new - line).max() < 1e-8, new
            if done:
                break
        self.line = line

    def probability(self, words: np.ndarray, cues: np.ndarray, has: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._planes(words, cues, has) @ self.line, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(spark: SparkSession, docs: DataFrame, examples: DataFrame, text: str = "text", label: str = "label", doc_id: str = "doc_id", most: int = EXAMPLES, labelled: dict[int, int] | None = None) -> Model:
    """A model from ``examples`` (text, label 0/1) with corpus statistics of all ``docs``.

    About ``most`` rows of each class are examples, chosen by a hash of doc_id and text, so a text
    that very many rows share is neither kept nor left as a whole. Equal texts of a label are one
    example, and so are near copies: a text whose runs of five words are alike (Jaccard 0.8 or
    more) to those of one of lesser hash goes, or else the words of a large family would pass for
    evidence. All their words are features of one vote, and all words and beginnings that depend
    on the label (chi-square) of the other. Rows with a null label are left out; a table without
    labelled rows gives a model that scores 0.5; labelled rows of which none is drawn raise an error.
    ``labelled``: rows of each class, if ``examples`` are a sample of them already. Document
    frequencies are counted over all of ``docs``.
    """
    scratch = Scratch(spark, "toxicity")
    texts = examples.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = F.lit(True)
    for value, n in sizes.items():
        if n > most:
            few = few & ((F.col("label") != value) | (F.pmod(F.col("h"), F.lit(1_000_003)) < int(1_000_003 * most / n)))
    drawn = texts.where(few).groupBy("text", "label").agg(F.min("h").alias("h"), F.min("doc_id").alias("doc_id"))
    drawn = scratch.write(drawn.mapInArrow(_sketches, "text string, label int, h long, doc_id long, keys array<long>"))
    chosen = scratch.write(drawn.join(_near_copies_of_lesser(drawn), ["h", "label"], "left_anti").select("text", "label", "doc_id"))
    if sizes and not chosen.head(1):
        raise ValueError("no labelled row was drawn; raise the bound on examples")

    def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, term, n = _counts(_split(part, 0))
                label_of = part.column(1).to_numpy()[row]
                for level in LEVELS:
                    some = n >= level
                    terms, where = np.unique(term[some], return_inverse=True)
                    pos = np.bincount(where, weights=label_of[some], minlength=terms.size).astype(np.int64)
                    both = np.bincount(where, minlength=terms.size)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(np.full(terms.size, level, np.int32)), pa.array(pos), pa.array(both - pos)], ["term", "level", "pos", "neg"])

    totals = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    terms: list = []
    if n1 and n0:
        counts = chosen.mapInArrow(term_counts, "term long, level int, pos long, neg long").groupBy("term", "level").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
        a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), n1 + n0
        chi = n * F.pow(a * (n0 - F.col("b")) - b * (n1 - F.col("a")), 2) / (n1 * n0 * (a + b) * F.greatest(n - a - b, F.lit(0.5)))
        strong = counts.where(F.col("a") + F.col("b") >= TERM_EXAMPLES).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
        strong = strong.orderBy(F.desc("chi"), "term", "level").collect()  # from the bounded examples
        known = np.unique(np.array([r["term"] for r in strong], np.int64).view(np.uint64))
        above: dict[int, list[int]] = {}
        for r in chosen.mapInArrow(_parents(known), "child long, parent long").distinct().collect():  # a few a term
            above.setdefault(r["child"], []).append(r["parent"])
        chi_of = {(r["term"], r["level"]): r["chi"] for r in strong}
        # A word whose beginning says as much says nothing more.
        terms = [r for r in strong if all(chi_of.get((p, r["level"]), 0.0) < r["chi"] for p in above.get(r["term"], ()))]
    hashes = np.array([r["term"] for r in terms], np.int64).view(np.uint64)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(hashes, np.array([r["level"] for r in terms], np.int32)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(_split(part, 0).hashes())))], ["term"])

    # All words of the bounded examples.
    every = spark.sparkContext.broadcast(np.sort(chosen.mapInArrow(hashed, "term long").distinct().toArrow().column("term").to_numpy().view(np.uint64)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with each term, then all texts, then texts with each word."""
        total, known = vocabulary.value.size, every.value
        found = np.zeros(total + 1 + known.size, np.int64)
        for batch in batches:
            for part in slices(batch):
                words = _split(part, 0)
                found[:total] += np.bincount(vocabulary.value.rows(words)[1], minlength=total)[:total]
                found[total] += part.num_rows
                found[total + 1 :] += np.bincount(_word_counts(words, known)[1], minlength=known.size)[: known.size]
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["place", "n"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                split = _split(part, 0)
                keys = [",".join(map(str, v)) for v in vocabulary.value.lists(split)]
                row, place, n = _word_counts(split, every.value)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                pairs = np.stack([place, n], axis=1).astype("<i4")
                words = [pairs[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(keys, pa.string()), part.column(1), part.column(2)], ["words", "vector", "label", "doc_id"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(hashes.size + 1 + every.value.size)
    df[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + df[hashes.size]) / (1 + df)) + 1
    # Texts of equal words have equal cues.
    grouped = chosen.mapInArrow(vectors, "words binary, vector string, label int, doc_id long").groupBy("words", "vector").agg(F.sum("label").alias("pos"), F.count("*").alias("n"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("id")).toArrow()
    grouped = grouped.sort_by([("words", "ascending")])
    flat = grouped.column("words").cast(pa.large_binary()).combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    _, cuts, raw = flat.buffers()
    cuts = np.frombuffer(cuts, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    flat = np.frombuffer(raw, "<i4")[cuts[0] // 4 : cuts[-1] // 4].reshape(-1, 2) if raw is not None else np.zeros((0, 2), np.int32)
    ids = grouped.column("id").to_numpy()
    pos = grouped.column("pos").to_numpy().astype(float)
    neg = grouped.column("n").to_numpy() - pos
    names, cue = np.unique(np.array(grouped.column("vector").to_pylist(), object).astype(str), return_inverse=True) if grouped.num_rows else (np.zeros(0, str), np.zeros(0, np.int64))
    by_cue = [np.bincount(cue, weights=x, minlength=names.size) for x in (pos, neg)]
    parsed = [([int(x) for x in v.split(",") if x], p, n) for v, p, n in zip(names.tolist(), *by_cue, strict=True)]
    known = labelled or sizes
    factor = tuple(known.get(y, 0) / max(totals.get(y, 0), 1) for y in (0, 1))
    cues = Cues(vocabulary.value, idf[: hashes.size], parsed, factor)
    size = grouped.num_rows
    del grouped, df, counted
    model = Model(every.value, idf[hashes.size + 1 :], (cuts - cuts[0]) // 8, flat[:, 0].copy(), flat[:, 1], pos, neg, ids, factor, cues, cue)
    del flat, raw
    shared = spark.sparkContext.broadcast(model)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in shared.value.others(batch.column(0).to_numpy())], ["words", "cues", "has", "y", "w"])

    if size:
        votes = spark.range(0, size, 1, -(-size // (4 * QUERIES))).mapInArrow(others, "words double, cues double, has double, y double, w double").toArrow()
        model.calibrate(*[votes.column(c).to_numpy() for c in ("words", "cues", "has", "y", "w")])
    shared.unpersist()
    every.unpersist()
    vocabulary.unpersist()
    scratch.drop(drawn, chosen)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, neighbours) for every row, and the columns ``carry``: the calibrated vote of the nearest examples.

    ``neighbours``, the evidence: the three nearest groups of examples with equal words, by their
    least doc_id, with cosine and number of positive and negative examples; equal cosines rank by
    the groups' fixed order. Texts that share no word with the examples, empty and null ones among
    them, get the share of positive examples as that vote. Repeated rows stay; an empty table
    gives no rows; columns not carried are not read, and a carried column may not be named score
    or neighbours.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                words = _split(part, 1)
                keys = [tuple(terms) for terms in m.cues.vocabulary.lists(words)]
                if len(known) > 100_000:
                    known.clear()
                fresh = list({key for key in keys if key not in known})
                known.update(zip(fresh, m.cues.votes([np.array(key, np.int64) for key in fresh]).tolist(), strict=True))
                votes, evidence = [], []
                for key, (vote, near) in zip(keys, m.votes(words), strict=True):
                    votes.append((vote, known[key], float(bool(key))))
                    evidence.append([{"doc_id": int(m.ids[x]), "cosine": c, "positive": int(m.pos[x]), "negative": int(m.neg[x])} for x, c in near])
                out = m.probability(*np.array(votes).T)
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("positive", pa.int64()), ("negative", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64()), pa.array(evidence, kind), *part.columns[2:]], ["doc_id", "score", "neighbours", *carry])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"), *carry)
    schema = StructType.fromDDL("doc_id long, score double, neighbours array<struct<doc_id: long, cosine: double, positive: long, negative: long>>")
    return source.mapInArrow(run, StructType([*schema.fields, *source.schema.fields[2:]]))
