"""Token counts of every prefix of a text by dynamic programming, for byte-level BPE vocabularies."""

from __future__ import annotations

import collections
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from tokenizers import Tokenizer

from lettings.llm.common import slices

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: What a worker remembers: units (twice as many, of so many characters) and pairs of tokens.
KEPT_UNITS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 64, 1_000_000
#: Latin letters after at most one space are one piece, stops behind them another; so on the next line.
_LETTERS, _STOPS = "[A-Za-zÀ-ÖØ-öø-ſ]+", "[.,;:!?]*"
SIMPLE = rf"^(?P<word> ?{_LETTERS})(?P<stops>{_STOPS})(?:(?P<line>\n)(?P<word2>{_LETTERS})(?P<stops2>{_STOPS}))?$"
#: Contractions that are one piece when whole, but two when cut before their last letter.
CUT_IN_TWO = ("'re", "'ve", "'ll")


class Recent:
    """A store of bounded size in two halves: when one is full the other is given up, what is used moves on."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> None:
        self.young[key] = value
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


class PrefixCounter:
    """Exact token counts of all prefixes of texts.

    The last token of a prefix is the longest vocabulary entry at its end that may stand
    after the last token of what comes before it: two neighbours are possible exactly if
    the vocabulary encodes their joined bytes as those two, and neighbours decide all.
    So ``count[i] = count[i - len(last)] + 1``, with no prefix encoded again.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pieces_of = self.tokenizer.model, self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        if "ByteLevel" not in str(self.pieces_of) or self.tokenizer.normalizer or any(
            t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added
        ):
            raise ValueError("Prefix counts are for byte-level BPE without a normaliser, and special strings without blanks")
        specials = sorted((t.content for t in added), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        #: stand-ins of the bytes in the vocabulary; here bytes are kept as Latin-1 characters
        self.stand_in = self.byte_stand_ins()
        back = {ord(s): chr(b) for b, s in self.stand_in.items()}
        plain = set(self.tokenizer.get_vocab(with_added_tokens=False)) - set(specials)
        self.vocabulary = {t.translate(back) for t in plain if len(self.model.tokenize(t)) == 1}
        tails: dict[str, set[int]] = collections.defaultdict(set)
        for t in self.vocabulary:
            tails[t[-3:]].add(len(t))
        #: lengths of the entries that end in these three bytes, longest first
        self.tails = {k: (*sorted(v, reverse=True), 2, 1) for k, v in tails.items() if len(k) == 3}
        blank = [chr(c) for c in range(0x3001) if chr(c).isspace() or c in (0x180E, 0x200B)]
        self.blank = frozenset(c for c in blank if len(self.pieces_of.pre_tokenize_str(f"!{c}!")) > 1)
        self.open = rf"(?:\A|[{''.join(map(re.escape, blank))}])\z"
        self.run = re.compile(f"[{''.join(map(re.escape, sorted(self.blank)))}]{{2,}}")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units = Recent(KEPT_UNITS)

    def byte_stand_ins(self) -> dict[int, str]:
        """The characters that stand for bytes, as a table for texts decoded from Latin-1."""
        out = {}
        for c in map(chr, [*range(0x80), *range(0x80, 0x800), *range(0x1000, 0x10000, 0x1000), 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000]):
            if not 0xD800 <= ord(c) < 0xE000:
                shown = "".join(p for p, _ in self.pieces_of.pre_tokenize_str(c))
                out.update(zip(c.encode(), shown, strict=True))
        return out

    def possible(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens may stand side by side."""
        left, right = (t.translate(self.stand_in) for t in pair)
        parts = self.model.tokenize(left + right)
        found = len(parts) == 2 and parts[0].value == left
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = found
        return found

    def grow(self, piece: str, counts: list[int], last: list[str]) -> None:
        """Extends the counts and last tokens of the beginning of a piece (of bytes) to all of its prefixes."""
        vocabulary, tails, pairs, possible = self.vocabulary, self.tails, self.pairs, self.possible
        for i in range(len(counts), len(piece) + 1):
            for n in tails.get(piece[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                if n > i:
                    continue
                token = piece[i - n : i]
                if token in vocabulary:
                    before = last[i - n]
                    if before:
                        pair = before, token
                        fits = pairs.get(pair)
                        if not (possible(pair) if fits is None else fits):
                            continue
                    counts.append(counts[i - n] + 1)
                    last.append(token)
                    break

    def piece_counts(self, piece: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a piece."""
        raw = as_bytes(piece)
        counts, last = [0], [""]
        self.grow(raw, counts, last)
        return [1, 2, counts[-1]] if piece in CUT_IN_TWO else at_characters(raw, counts)

    def sorted_counts(self, pieces: list[str]) -> list[list[int]]:
        """``piece_counts`` of sorted pieces; each goes on where it leaves the one before."""
        counts, last = [0], [""]
        out = []
        raws = [as_bytes(p) for p in pieces]
        for raw, shared in zip(raws, shared_lengths(raws), strict=True):
            del counts[shared + 1 :], last[shared + 1 :]
            self.grow(raw, counts, last)
            out.append(at_characters(raw, counts))
        return out

    def plain_counts(self, text: str) -> list[int]:
        """Counts of the prefixes of a text without special strings."""
        counts: list[int] = []
        before = 0
        for _, (a, b) in self.pieces_of.pre_tokenize_str(text):
            part = self.piece_counts(text[a:b])
            counts += [before + c for c in part] if before else part
            before = counts[-1]
        # a prefix that ends in a run of blanks has the run as one piece
        for run in self.run.finditer(text):
            a, b = run.span()
            start = counts[a - 1] if a else 0
            counts[a:b] = [start + c for c in self.piece_counts(run.group())]
        return counts

    def text_counts(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a text."""
        if not (self.special and self.special.search(text)):
            return self.plain_counts(text)
        counts: list[int] = []
        at, before = 0, 0
        for hit in self.special.finditer(text):
            # a prefix that ends inside the special string has it as common text
            counts += [before + c for c in self.plain_counts(text[at : hit.end() - 1])]
            before = (counts[hit.start() - 1] if hit.start() > at else before) + 1
            counts.append(before)
            at = hit.end()
        return counts + [before + c for c in self.plain_counts(text[at:])]

    def unit_counts(self, units: list[str], simple: bool) -> list[bytes]:
        """Counts of the prefixes of each unit as packed integers; short units seen lately are not worked on again.

        Simple units are one piece each.
        """
        young, old = self.units.young, self.units.old
        out = [young.get(u) for u in units]
        moved = [i for i, found in enumerate(out) if found is None]
        for i in moved:
            out[i] = old.get(units[i])
        new = [i for i, found in enumerate(out) if found is None]
        if simple:
            new.sort(key=units.__getitem__)
            counts = self.sorted_counts([units[i] for i in new])
        else:
            counts = (self.text_counts(units[i]) for i in new)
        for i, own in zip(new, counts, strict=True):
            out[i] = array("i", own).tobytes()
        for i in moved:
            if len(units[i]) <= KEPT_LENGTH:
                self.units.put(units[i], out[i])
        return out

    def batch_counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of all prefixes of all texts in one array, where each text begins in it, and the totals.

        Texts are cut before each space that follows a character that is no blank: no piece
        and no rule reaches over such a place, in a text or in its prefixes.
        """
        lists = pc.split_pattern(texts, " ")
        begins = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        begins = begins - begins[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names, n = coded.dictionary, len(codes)
        first = np.zeros(n, bool)
        first[begins[:-1]] = True  # every text has a word, be it an empty one
        open_name = pc.match_substring_regex(names, self.open).to_numpy(zero_copy_only=False)
        joined = np.zeros(n, bool)
        joined[1:] = open_name[codes[:-1]] & ~first[1:]
        heads = np.flatnonzero(~joined)
        sizes = np.diff(np.append(heads, n))
        one = sizes == 1
        mixed = codes[heads] * 2 + first[heads]
        found, inverse = np.unique(mixed[one], return_inverse=True)
        lead = pc.if_else(pa.array(found & 1 == 1), "", " ")
        chunks = pc.binary_join_element_wise(lead, names.take(pa.array(found >> 1)), "")
        several = np.flatnonzero(~one)
        joined_words = []
        for h in several.tolist():
            words = " ".join(names.take(pa.array(codes[heads[h] : heads[h] + sizes[h]])).to_pylist())
            joined_words.append(words if first[heads[h]] else " " + words)
        chunks = pa.concat_arrays([chunks, pa.array(joined_words, pa.string())])
        chunk = np.empty(len(heads), np.int64)
        chunk[one] = inverse
        chunk[several] = len(found) + np.arange(len(several))
        # a simple chunk is five units, some of them empty: word, stops, line break, word, stops; another one is one
        split = pc.extract_regex(chunks, SIMPLE)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        simple = split.filter(split.is_valid())
        unit, used = np.zeros((len(chunks), 5), np.int64), [b""]
        columns = [("word", "word2"), ("stops", "stops2"), ("line",)]
        for names_ in columns:
            both = pa.concat_arrays([simple.field(c) for c in names_]).dictionary_encode()
            places = both.indices.to_numpy(zero_copy_only=False).reshape(len(names_), len(simple))
            for c, own in zip(names_, places, strict=True):
                unit[plain, ["word", "stops", "line", "word2", "stops2"].index(c)] = len(used) + own
            used += self.unit_counts(both.dictionary.to_pylist(), names_[0] == "word")
        others = chunks.filter(pa.array(~plain)).to_pylist()
        unit[~plain, 0] = len(used) + np.arange(len(others))
        used += self.unit_counts(others, False)
        flat = np.frombuffer(b"".join(used), np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, used), np.int64, len(used)) // 4)])
        flat, offsets = joined_counts(unit.ravel(), np.arange(0, unit.size + 1, 5), flat, offsets)  # of the chunks
        counts, bounds = joined_counts(chunk, np.searchsorted(heads, begins), flat, offsets)  # of the texts
        totals = np.zeros(len(texts), np.int64)
        some = np.diff(bounds) > 0
        totals[some] = counts[bounds[1:][some] - 1]
        return counts, bounds, totals


def joined_counts(parts: np.ndarray, begins: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of groups of parts, each going on from the one before, and where each group begins.

    ``flat`` has the counts of part ``i`` from ``offsets[i]`` on; a group begins at each of ``begins``.
    """
    lengths, totals = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
    some = lengths > 0
    totals[some] = flat[offsets[1:][some] - 1]
    length = lengths[parts]
    ahead, out = np.concatenate([[0], np.cumsum(totals[parts])]), np.concatenate([[0], np.cumsum(length)])
    base = ahead[:-1] - np.repeat(ahead[begins[:-1]], np.diff(begins))
    at = np.arange(out[-1], dtype=np.int32)
    at += np.repeat((offsets[parts] - out[:-1]).astype(np.int32), length)
    counts = flat[at]
    counts += np.repeat(base.astype(np.int32), length)
    return counts, out[begins]


def as_bytes(text: str) -> str:
    """The bytes of a text as Latin-1 characters."""
    return text if text.isascii() else text.encode().decode("latin-1")


def at_characters(raw: str, counts: list[int]) -> list[int]:
    """Of counts at all bytes, from 0 on, those where a character ends."""
    if raw.isascii():
        return counts[1:]
    return [c for c, after in zip(counts[1:], [*raw[1:], ""], strict=True) if not "\x80" <= after <= "\xbf"]


def shared_lengths(raws: list[str]) -> list[int]:
    """How many bytes each text has in common with the one before."""
    if not raws:
        return []
    width = max(1, min(KEPT_LENGTH, max(map(len, raws))))
    rows = np.array([r[:width].encode("latin-1") for r in raws], f"S{width}").view(np.uint8).reshape(len(raws), width)
    equal = np.cumprod((rows[1:] == rows[:-1]) & (rows[1:] != 0), axis=1, dtype=np.uint8)
    return [0, *equal.sum(axis=1, dtype=np.int64).tolist()]


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> PrefixCounter:
    """The counter of a vocabulary file, a full path or a name that the tokenizer package knows; one a worker."""
    return PrefixCounter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def prefix_counts(
    docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "prefix_tokens",
) -> DataFrame:
    """Adds the array ``name``: entry ``i`` is the number of tokens of the text's first ``i`` characters (from 1).

    Special strings in a text are special tokens, as the library takes them; none are
    added.  The counts need not rise with the prefix.  Null and empty texts have an empty
    array; repeated rows stay; an empty table gives no rows; a column ``name`` is replaced.
    Texts are read in slices of some megabytes, but one text is never cut.
    """
    base = docs.drop(name)
    schema = StructType([*base.schema.fields, StructField(name, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = pc.fill_null(part.column(text), "")
                counts, begins, _ = counter(vocabulary).batch_counts(texts)
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(counts, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, name])

    return base.mapInArrow(run, schema)


def tokens_of_prefix(counts: Column, characters: Column | int) -> Column:
    """Tokens of the first so many characters; of the whole text beyond its end."""
    n = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(counts))
    return F.when(n <= 0, F.lit(0)).otherwise(F.element_at(counts, F.greatest(n, F.lit(1))))


def n_tokens(counts: Column) -> Column:
    """Tokens of the whole text."""
    return tokens_of_prefix(counts, F.size(counts)).cast("long")


def longest_within(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most so many tokens."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.aggregate(
        counts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("best")),
        lambda s, c: F.struct(
            (s["at"] + 1).alias("at"), F.when(c <= limit, s["at"] + 1).otherwise(s["best"]).alias("best")
        ),
        lambda s: s["best"],
    )


def truncate(counted: DataFrame, budget: int, text: str = "text", counts: str = "prefix_tokens") -> DataFrame:
    """Texts cut to their longest prefix with at most ``budget`` tokens, and the counts with them."""
    n = longest_within(F.col(counts), budget)
    cut = counted.withColumn("__n", n)
    return cut.withColumns({
        text: F.substring(F.col(text), F.lit(1), F.col("__n")), counts: F.slice(F.col(counts), F.lit(1), F.col("__n")),
    }).drop("__n")


def totals(counted: DataFrame, text: str = "text", counts: str = "prefix_tokens", limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of each counted text, and whether the tokens exceed ``limit``; the other columns stay."""
    whole = n_tokens(F.col(counts))
    return counted.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": whole,
        "over_limit": whole > limit,
    }).drop(text, counts)
