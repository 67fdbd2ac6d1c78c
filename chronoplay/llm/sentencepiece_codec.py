"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into words (no piece goes over a word's end). The
words that the task hasn't met yet are concatenated and indexed by a suffix
array; every piece of the vocabulary is looked up in it by binary search, which
gives the range of all its occurrences. Each occurrence is an edge between two
positions. The edges are sorted by position and relaxed in that order, all
words side by side; in words of more than ``STEPS`` characters all pairs of
edges that meet are tested side by side, and a word of any length goes window
by window.

For a BPE vocabulary the relaxation keeps the encodings that the merges make:
each prefix of a word has exactly one encoding, so exactly one edge into a
position continues the encoding at the edge's start. An edge does so if its
piece and the one before it come out unchanged when their concatenation is
merged. For a unigram vocabulary it keeps the best sum of scores;
of equal sums it may take another than the library does, so only a BPE's ids are
the library's in every case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import row_slices, tidy

SPACE = "▁"
#: Characters of new words that are indexed at a time; a longer word goes by windows of so many.
INDEXED = 100_000
#: Bytes of texts that are encoded at a time, or one longer text, of which so many words at a time.
SLICE, AT_ONCE = 1 << 20, 100_000
#: Words of more characters than this aren't relaxed step by step.
STEPS = 64
#: Words that go back one after the other.
FEW = 8
#: Words that a worker remembers, of at most so many characters.
REMEMBER, LONG_WORD = 100_000, 64
NEVER = np.int64(1) << 40


class Vocabulary:
    """The pieces of a SentencePiece model, with the merge order of a BPE."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalisation are supported")
        self.dummy_prefix, self.bpe = spec.add_dummy_prefix, model.trainer_spec.model_type == 2
        normal, byte = 1, 6
        self.pieces = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces])
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == byte}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.high_byte = np.array([self.byte_of.get(i, 0) >= 128 for i in range(len(self.pieces))])
        self.shown = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.pieces)]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces over word ends are not supported")
        chars = {p for p in self.id if len(p) == 1}
        self.chars = chars
        # A word: spaces and what follows them, up to the next space, to white space without a piece, or
        # to a mark that no piece has right after a letter or digit. Pieces never go over its end.
        inner = {c for p in self.id for a, c in zip(p, p[1:]) if a.isalnum() or a == "_"}
        marks = "".join(re.escape(c) for c in sorted({*chars, *map(chr, range(33, 127))} - inner) if not (c.isalnum() or c in "_" + SPACE))
        other = "".join(c for c in "\n\t\r" if c not in chars)
        gap = rf"[^\w{SPACE}{other}]*+"
        self.words = re.compile(rf"{SPACE}*+(?:{gap}\w++" + (f"(?![{marks}])" if marks else "") + rf")*+{gap}\w*+" + (f"|[{other}]" if other else ""))
        usable = self._merge_order() if self.bpe else list(self.id)
        self.usable = sorted(usable)
        self.usable_ids = np.array([self.id[p] for p in self.usable], np.int64)
        self.longest = max(map(len, self.usable), default=1)
        # what binary search looks for: the least and the greatest suffix that begins with a piece
        kind = f"<U{self.longest}"
        self.low, self.high = np.array(self.usable, kind), np.array([(p + "\U0010ffff" * self.longest)[: self.longest] for p in self.usable], kind)
        self.lengths = np.array([len(p) for p in self.usable], np.int64)

    def _merge_order(self) -> list[str]:
        """Ranks, last merges and pairs of the BPE; the pieces that merging their characters gives."""
        n = len(self.pieces)
        order = sorted((p for p in self.id if len(p) > 1), key=lambda p: (-self.score[self.id[p]], self.id[p]))
        # one row more, for characters without a piece: they never merge
        self.rank, self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        for r, p in enumerate(order):
            self.rank[self.id[p]] = r
        usable = [p for p in self.id if len(p) == 1]
        for p in order:
            parts = list(p)
            while len(parts) > 2:
                best = min((self.rank[self.id[ab]], i) for i in range(len(parts) - 1) if (ab := parts[i] + parts[i + 1]) in self.id) if any(a + b in self.id for a, b in zip(parts, parts[1:])) else None
                if best is None or best[0] > self.rank[self.id[p]]:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and parts[0] in self.id and parts[1] in self.id:
                self.left[self.id[p]], self.right[self.id[p]] = self.id[parts[0]], self.id[parts[1]]
                usable.append(p)
        pairs = sorted(
            (self.id[p[:k]] * (n + 1) + self.id[p[k:]], int(self.rank[self.id[p]]))
            for p in order for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id
        )
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
        return usable

    def unchanged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the concatenation of pieces a[i] and b[i] gives these two again.

        Their merges are undone, latest first. At each moment a merge over the
        border would have come first if its rank is below the rank of what
        consumed the piece on the left, or not above that on the right.
        """
        n, ok = len(self.rank), np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        a_ends, b_ends = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            keys = a * n + b
            found = np.searchsorted(self.pair_keys, keys)
            found[found == len(self.pair_keys)] = 0
            over = np.where(self.pair_keys[found] == keys, self.pair_ranks[found], NEVER)
            crossed = (over < a_ends) & (over <= b_ends) & (over < NEVER)
            ok[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            more = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, a_ends, b_ends, ra, rb = (x[more] for x in (at, a, b, a_ends, b_ends, ra, rb))
            undo = ra > rb
            a_ends, b_ends = np.where(undo, ra, a_ends), np.where(undo, b_ends, rb)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` codes, by prefix doubling from the first four on."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    k = 4 if len(rank) and rank.max() < 1 << 15 else 1
    key = rank.copy()
    for j in range(1, k):
        key <<= 15
        key[:-j] += rank[j:]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        if k >= depth or rank[order[-1]] == len(rank):
            return order
        follow = np.zeros(len(rank), np.int64)
        follow[:-k or None] = rank[k:] if k < len(rank) else 0
        key = rank * (len(rank) + 2) + follow
        k *= 2


def occurrences(text: str, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece id) of every place where a piece stands in ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    order = suffix_array(codes, v.longest)
    padded = np.concatenate((codes, np.zeros(v.longest, np.uint32)))
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, v.longest)[order]).view(f"<U{v.longest}").ravel()
    low = np.searchsorted(heads, v.low, "left")
    count = np.searchsorted(heads, v.high, "right") - low
    which = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    start = order[place]
    return start, start + v.lengths[which], v.usable_ids[which]


def _merges_settle(v: Vocabulary, start: np.ndarray, end: np.ndarray, piece: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Which edges a BPE keeps, of words too long for steps: those that are settled, and those that continue one that is kept.

    All pairs of an edge and one that follows it are tested at once; what is left
    is a chain of flags, in the order of the starts.
    """
    n = len(v.pieces)
    by_end = np.argsort(end, kind="stable")
    ends = end[by_end]
    follow = np.flatnonzero(~settled)
    follow = follow[np.argsort(start[follow], kind="stable")]
    low = np.searchsorted(ends, start[follow], "left")
    count = np.searchsorted(ends, start[follow], "right") - low
    e = np.repeat(follow, count)
    p = by_end[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(e))]
    keys, back = np.unique(piece[p] * (n + 1) + piece[e], return_inverse=True)
    fits = v.unchanged(keys // (n + 1), keys % (n + 1))[back]
    kept = settled.tolist()
    for a, b in zip(p[fits].tolist(), e[fits].tolist(), strict=True):
        if kept[a]:
            kept[b] = True
    return np.array(kept, bool)


def _scores_settle(v: Vocabulary, start: np.ndarray, end: np.ndarray, piece: np.ndarray, best: dict[int, float]) -> np.ndarray:
    """Which edges a unigram keeps, of words too long for steps: the best into each position; ``best`` holds scores by position."""
    kept = np.zeros(len(start), bool)
    value = np.append(v.score, v.score.min() - 10)[piece].tolist()
    order = np.argsort(end, kind="stable")
    into: dict[int, int] = {}
    for i, s, e in zip(order.tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        score = best.get(s, -np.inf) + value[i]
        if score > best.get(e, -np.inf):
            best[e], into[e] = score, i
    kept[list(into.values())] = True
    return kept


def _bare(covered: np.ndarray, n: int, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges, and one of piece n for each character without a piece."""
    bare = np.flatnonzero(~covered)
    return np.concatenate((start, bare)), np.concatenate((end, bare + 1)), np.concatenate((piece, np.full(len(bare), n)))


def _spelled(flat: np.ndarray, odd: np.ndarray, chars: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the bytes of ``chars`` in place of the ids at ``odd``, and how many ids each old one became."""
    parts = [[v.bytes[x] for x in c.encode()] if v.bytes else [v.unknown] for c in chars]
    times = np.ones(len(flat), np.int64)
    times[odd] = [len(x) for x in parts]
    out = np.repeat(flat, times)
    out[out == len(v.pieces)] = [x for part in parts for x in part]
    return out, times


def encode_giant(word: str, v: Vocabulary) -> np.ndarray:
    """The piece ids of one word of any length, window by window: edges into a window only come from the ``longest`` characters before it."""
    n, size = len(v.pieces), len(word)
    last, from_ = np.full(size + 1, -1, np.int32), np.zeros(size + 1, np.int32)
    best: dict[int, float] = {0: 0.0}
    for a in range(0, size, INDEXED):
        back = max(0, a - v.longest)
        part = word[back : a + INDEXED]
        start, end, piece = occurrences(part, v)
        covered = np.zeros(len(part), bool)
        covered[start[end - start == 1]] = True
        start, end, piece = _bare(covered, n, start, end, piece)
        new = end + back > a
        start, end, piece = start[new] + back, end[new] + back, piece[new]
        if v.bpe:
            done = np.arange(back + 1, a + 1)
            starts, ends, pieces = (np.concatenate(x) for x in ((from_[done], start), (done, end), (last[done], piece)))
            settled = np.concatenate((np.ones(len(done), bool), start == 0))
            kept = _merges_settle(v, starts, ends, pieces, settled)[len(done) :]
        else:
            best = {i: x for i, x in best.items() if i >= back}
            kept = _scores_settle(v, start, end, piece, best)
        last[end[kept]], from_[end[kept]] = piece[kept], start[kept]
    at, ends = size, []
    while at:
        ends.append(at)
        at = int(from_[at])
    ends = np.array(ends[::-1])
    flat = last[ends]
    odd = np.flatnonzero(flat == n)
    return _spelled(flat, odd, [word[i] for i in from_[ends[odd]].tolist()], v)[0].astype(np.int32) if len(odd) else flat.astype(np.int32)


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of all words, and how many each has."""
    text = "\0".join(words) + "\0"
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    start, end, piece = occurrences(text, v)
    n = len(v.pieces)
    # characters without a piece are edges too; n stands for their bytes. "\0" ends words and has none.
    covered = np.zeros(len(text), bool)
    covered[start[end - start == 1]] = True
    covered[begin + size] = True
    start, end, piece = _bare(covered, n, start, end, piece)
    word_of = np.repeat(np.arange(len(words)), size + 1)
    inside = end - begin[word_of[start]]
    by_end = np.argsort(inside.astype(np.uint16) if size.max() < 1 << 16 else inside, kind="stable")  # of short numbers by their digits
    start, end, piece, inside = start[by_end], end[by_end], piece[by_end], inside[by_end]
    last = np.full(len(text) + 1, -1, np.int64)  # piece that ends at a position
    from_ = np.zeros(len(text) + 1, np.int64)
    first = np.zeros(len(text) + 1, bool)
    first[begin] = True
    long = size[word_of[start]] > STEPS
    if long.any():
        s, e, p = start[long], end[long], piece[long]
        kept = _merges_settle(v, s, e, p, first[s]) if v.bpe else _scores_settle(v, s, e, p, dict.fromkeys(begin.tolist(), 0.0))
        last[e[kept]], from_[e[kept]] = p[kept], s[kept]
        start, end, piece, inside = start[~long], end[~long], piece[~long], inside[~long]
    steps = np.searchsorted(inside, np.arange(1, int(inside[-1]) + 2)) if len(inside) else np.zeros(1, np.int64)
    best = np.full(len(text) + 1, -np.inf)
    best[begin] = 0
    for lo, hi in zip(steps[:-1], steps[1:], strict=True):
        s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
        if v.bpe:
            opens = first[s]
            before = last[s]
            ask = np.flatnonzero(~opens & (before >= 0))
            keys, back = np.unique(before[ask] * (n + 1) + p[ask], return_inverse=True)
            good = opens.copy()
            good[ask] = v.unchanged(keys // (n + 1), keys % (n + 1))[back]
            s, e, p = s[good], e[good], p[good]
        else:
            score = best[s] + np.append(v.score, v.score.min() - 10)[p]
            o = np.lexsort((-score, e))
            s, e, p, score = s[o], e[o], p[o], score[o]
            top = np.concatenate(([True], e[1:] != e[:-1]))
            s, e, p = s[top], e[top], p[top]
            best[e] = score[top]
        last[e], from_[e] = p, s
    # all words go back from their ends together
    at, live, places, owner = begin + size, np.arange(len(words)), [], []
    while len(live):
        going = at > begin[live]
        live, at = live[going], at[going]
        if 0 < len(live) <= FEW:  # only long words are left: one after the other
            for w, i in zip(live.tolist(), at.tolist(), strict=True):
                mine, low = [], int(begin[w])
                while i > low:
                    mine.append(i)
                    i = int(from_[i])
                places.append(np.array(mine))
                owner.append(np.full(len(mine), w))
            break
        places.append(at)
        owner.append(live)
        at = from_[at]
    ends, who = np.concatenate(places)[::-1], np.concatenate(owner)[::-1]
    turn = np.argsort(who, kind="stable")
    ends, who = ends[turn], who[turn]
    flat = last[ends]
    if len(odd := np.flatnonzero(flat == n)):
        flat, times = _spelled(flat, odd, [text[i] for i in from_[ends[odd]].tolist()], v)
        who = np.repeat(who, times)
    return flat.astype(np.int32), np.bincount(who, minlength=len(words))


def encoder(path: str):
    """A function from texts to (piece ids of all, ids of each), which remembers short words between calls."""
    v = load(path)
    known: dict[str, int] = {}
    flat, count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode_list(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        nonlocal flat, count
        new = list(set(words).difference(known))  # the empty word, which the pattern finds at ends, has no ids
        long = [w for w in new if len(w) > LONG_WORD]
        if long:
            new = [w for w in new if len(w) <= LONG_WORD] + long
        parts, waiting, chars = [(flat, count)], [], 0
        for w in new:
            if len(w) > INDEXED:
                if waiting:
                    parts.append(encode_words(waiting, v))
                    waiting, chars = [], 0
                ids = encode_giant(w, v)
                parts.append((ids, np.array([len(ids)])))
                continue
            waiting.append(w)
            chars += len(w) + 1
            if chars > INDEXED:
                parts.append(encode_words(waiting, v))
                waiting, chars = [], 0
        if waiting:
            parts.append(encode_words(waiting, v))
        ids, sizes = np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])
        old = len(count)
        short = len(new) - len(long)
        if len(known) < REMEMBER:  # frequent words come early
            known.update(zip(new[:short], range(old, old + short), strict=True))
            flat, count = ids[: int(sizes[: old + short].sum())].copy(), sizes[: old + short].copy()
            index = known if short == len(new) else dict(known)
        else:
            index = dict(known)
        if index is not known:
            index.update(zip(new, range(old, len(sizes)), strict=True))
        which = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        each, start = sizes[which], (np.cumsum(sizes) - sizes)[which]
        done = np.cumsum(each)
        return ids[np.repeat(start - (done - each), each) + np.arange(done[-1] if len(done) else 0)], each

    def prepared(text: str) -> str:
        return ((SPACE if v.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > SLICE:  # a huge text's words needn't be there all at once
            words, parts = (m[0] for m in v.words.finditer(prepared(texts[0]))), []
            while some := list(islice(words, AT_ONCE)):
                parts.append(encode_list(some)[0])
            out = np.concatenate(parts)
            return out, np.array([len(out)])
        cut = [v.words.findall(prepared(t)) for t in texts]
        out, each = encode_list(list(chain.from_iterable(cut)))
        total = np.concatenate(([0], np.cumsum(each)))
        return out, np.diff(total[np.concatenate(([0], np.cumsum([len(c) for c in cut])))])

    return encode


def decode(ids: np.ndarray | list[int], path: str) -> str:
    """The text of piece ids: runs of byte pieces are UTF-8, the leading space of the encoding goes."""
    v, ids = load(path), np.asarray(ids, np.int64)
    out, at = [], 0
    high = np.flatnonzero(v.high_byte[ids])  # the other bytes are characters by themselves
    for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1) if len(high) else ():
        out += map(v.shown.__getitem__, ids[at : run[0]].tolist())
        out.append(bytes(v.byte_of[i] for i in ids[run].tolist()).decode("utf-8", "replace"))
        at = int(run[-1]) + 1
    text = "".join(out) + "".join(map(v.shown.__getitem__, ids[at:].tolist()))
    return (text[1:] if v.dummy_prefix and text.startswith(SPACE) else text).replace(SPACE, " ")


def sentencepiece_codec(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ids, n_tokens, ids_sha256, decoded_sha256, round_trip.

    ``ids`` are those of the library for the whole text, without begin or end.
    ``ids_sha256`` is of the ids as little-endian 32-bit numbers; ``decoded_sha256`` of
    the text that decoding them gives, in UTF-8; ``round_trip`` tells whether it
    is the text itself (a text that holds U+2581 gets spaces back). Null counts
    as empty: no ids. Ids of rows are passed on as they are, nulls and repeats
    too; an empty table gives an empty result. Only the two named columns are
    read. Time and memory are linear in a text's length, also in one without
    spaces; what a worker remembers between rows is bounded.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_path)
        for whole in batches:
            for low, high in row_slices(whole.column(1), SLICE):
                b = whole.slice(low, high - low)
                texts = b.column(1).to_pylist()
                ids, counts = encode(texts)
                ends = np.concatenate(([0], np.cumsum(counts)))
                each = [ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                back = [decode(x, model_path) for x in each]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in each], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        pa.array([t == o for t, o in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    ["_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    out = base.mapInArrow(tidy(run), f"_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    return out.select(F.col("_id").alias(id_col), *out.columns[1:])
