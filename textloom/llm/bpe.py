"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list alone bounds how far text to the right can change a token: `lookahead()` follows, in rank order, which merges can take a
symbol away from a merge that would otherwise happen. A token whose end lies at least that far (plus the longest token) before the end of what has been read
is final, so `stream()` holds a buffer of fixed size however long the piece is. Short pieces take one step.

White space ends every word, so that no merge, normal form or special token reaches over it: a text is read in parts of about `PART` letters cut there (`Encoder.parts_of`), tokens of a part are final when it has been read, and
both decoders take them as they come and keep at most three bytes. What is held at once is a bounded group of parts, whatever the length of the text. Results equal the `tokenizers` library's; a bounded cache of words only saves
repeated steps.

Defined cases: null and empty text give no token; text of any length is encoded whole; special tokens' strings become their ids, as in the library;
repeated rows give equal rows; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textloom.llm.common import SLICE_BYTES, slices, table

VOCABULARY = "word_bpe_49k.json"

#: White space as the tokenizer file's \s has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
SPLIT = regex.compile(rf"[^{WHITE}]+")
#: str.split() would also cut at these.
ODD = regex.compile("[\x1c-\x1f]")
GAP = regex.compile(f"[{WHITE}]")
#: Letters of a part of a text.
PART = 1 << 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """The word-end BPE of a tokenizers file."""

    def __init__(self, path: str, cache: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.said = [self.names.get(i, "").encode() for i in range(max(self.names) + 1)]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        letters = byte_letters()
        self.to_bytes = {x: i for i, x in enumerate(letters)}
        bare = lambda name: bytes(self.to_bytes[c] for c in name.removesuffix(self.suffix)) + b" " * name.endswith(self.suffix)
        self.plain = [b"" if (name := self.names.get(i)) is None else name.encode() if name in self.special else bare(name) for i in range(max(self.names) + 1)]
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + self.suffix] for x in letters], np.int64)
        self.width = {int(i): 1 for i in (*self.inner, *self.final)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = (vocab[t] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocab[self.names[x] + self.names[y]]
            self.merges.setdefault((x, y), (rank, made))
            self.width[made] = self.width[x] + self.width[y]
        self.hold = self.lookahead() + max(self.width.values())
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = (np.array([m[i] for m in self.merges.values()], np.int64)[order] for i in (0, 1))
        self.none = len(keys) + 1
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.most = cache

    def lookahead(self) -> int:
        """Bytes right of a token that can decide whether it forms.

        By rank: for a merge (a, b), b itself must have formed, nothing of lower rank may have taken b for a merge (b, c) - which
        needs c and what c depends on - and a must have formed, of whose lookahead b already covers its own width.
        """
        reach = dict.fromkeys(self.width, 0)
        taken: dict[int, int] = {}
        for (a, b), (_, made) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            need = max(reach[b], taken.get(b, 0), reach[a] - self.width[b])
            reach[made] = max(reach[made], need)
            taken[a] = max(taken.get(a, 0), self.width[b] + need)
        return max(reach.values(), default=0)

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of symbols, where their merges stand in the table (-1: no such merge)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of many buffers at once: symbols end to end, lengths by buffer; the tokens likewise.

        Each step makes, in every buffer that still has one, the merge of the lowest rank, the leftmost of equal ones.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which, lengths = np.flatnonzero(lengths > 0), lengths[lengths > 0]
        total = len(which)
        where = None
        while len(which):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            if where is None:
                where = np.full(len(symbols), -1)
                where[:-1] = self.found(symbols[:-1], symbols[1:])
                where[ends - 1] = -1
            at = np.arange(len(symbols))
            best = np.minimum.reduceat(np.where(where >= 0, self.ranks[where], self.none) << 32 | at, starts)
            live = best >> 32 < self.none
            if not live.all():
                keep = np.repeat(live, lengths)
                out.append((which[~live], lengths[~live], symbols[~keep]))
                moved = np.cumsum(keep) - 1
                symbols, where, which, lengths, best = symbols[keep], where[keep], which[live], lengths[live], best[live]
                if not len(which):
                    break
                ends = np.cumsum(lengths)
                starts = ends - lengths
                spot = moved[best & 0xFFFFFFFF]
            else:
                spot = best & 0xFFFFFFFF
            symbols[spot] = self.made[where[spot]]
            gone = np.ones(len(symbols), bool)
            gone[spot + 1] = False
            left, last = spot - (spot > starts), spot + 1 == ends - 1
            symbols, where = symbols[gone], where[gone]
            lengths = lengths - 1
            shift = np.arange(len(spot))
            spot, left = spot - shift, left - shift
            after = np.minimum(spot + 1, len(symbols) - 1)
            where[spot] = np.where(last, -1, self.found(symbols[spot], symbols[after]))
            inside = left < spot
            where[left[inside]] = self.found(symbols[left[inside]], symbols[spot[inside]])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, counts, tokens = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(ids, kind="stable")
        begun = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        firsts = np.cumsum(counts) - counts
        tokens = tokens[np.repeat(begun - firsts, counts) + np.arange(counts.sum())]
        assert len(counts) == total
        return tokens, counts

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that comes as chunks of bytes: emitted once stable, over a buffer of fixed size."""
        most, held = 4 * self.hold, bytearray()
        for chunk in chunks:
            for i in range(0, len(chunk), self.hold):
                held += chunk[i : i + self.hold]
                if len(held) > most:
                    done = 0
                    for token in self.merge(self.inner[np.frombuffer(held[:most], np.uint8)], np.array([most]))[0].tolist():
                        if done + self.width[token] > most - self.hold:
                            break
                        done += self.width[token]
                        yield token
                    del held[:done]
        if held:
            symbols = self.inner[np.frombuffer(held, np.uint8)]
            symbols[-1] = self.final[held[-1]]
            yield from self.merge(symbols, np.array([len(held)]))[0].tolist()

    def pieces(self, words: list[str]) -> list[list[str]]:
        """The normalised pieces of words without white space."""
        text = unicodedata.normalize("NFC", "\n".join(words))
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return [[w] if w.isalpha() else PIECES.findall(w) for w in text.split("\n")]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, all in one step; pieces longer than the buffer go through stream()."""
        cut = self.pieces(words)
        distinct = list({p for pieces in cut for p in pieces})
        raw = [p.encode() for p in distinct]
        known = {p: np.fromiter(self.stream([r]), "<u4").tobytes() for p, r in zip(distinct, raw, strict=True) if len(r) > 4 * self.hold}
        if known:
            distinct, raw = [p for p in distinct if p not in known], [r for r in raw if len(r) <= 4 * self.hold]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        tokens, counts = self.merge(symbols, lengths)
        flat, ends = tokens.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        known |= {p: flat[b:e] for p, b, e in zip(distinct, [0, *ends], ends, strict=False)}
        return {w: known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces]) for w, pieces in zip(words, cut, strict=True)}

    def words(self, text: str) -> list[str]:
        return SPLIT.findall(text) if ODD.search(text) else text.split()

    def parts(self, text: str) -> list[list[str] | int]:
        """The text's words, cut where special tokens stand, and those."""
        if "<|" not in text:
            return [self.words(text)]
        out: list[list[str] | int] = []
        at = 0
        for m in self.special_split.finditer(text):
            out += [self.words(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return [*out, self.words(text[at:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        get, missing, rows = self.cache.get, set(), []
        for t in texts:
            row = []
            for words in self.parts(t or ""):
                if isinstance(words, int):
                    row.append((None, [words.to_bytes(4, "little")]))
                    continue
                ids = list(map(get, words))
                if not all(ids):
                    missing.update(w for w, x in zip(words, ids, strict=True) if x is None)
                row.append((words, ids))
            rows.append(row)
        if missing:
            known = self._recalled(missing)
            for row in rows:
                for words, ids in row:
                    if not all(ids):
                        ids[:] = [known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return [b"".join(chain.from_iterable(ids for _, ids in row)) for row in rows]

    @staticmethod
    def parts_of(text: str) -> Iterator[str]:
        """The text in parts of PART letters or a little more, cut before white space."""
        at = 0
        while len(text) - at > PART:
            gap = GAP.search(text, at + PART)
            if not gap:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def transduce(self, texts: Iterable[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, bytes]]:
        """(which text, ids of its next part), in order; parts of about `most` letters in all are held at once."""
        held: list[tuple[int, str]] = []
        letters = 0
        for i, t in enumerate(texts):
            for part in self.parts_of(t or ""):
                held.append((i, part))
                letters += len(part)
                if letters >= most:
                    yield from zip([i for i, _ in held], self.encode([p for _, p in held]), strict=True)
                    held, letters = [], 0
        yield from zip([i for i, _ in held], self.encode([p for _, p in held]), strict=True)

    def _recalled(self, missing: set[str]) -> dict[str, bytes]:
        """Words that are not in the cache: from the one before it, or learnt. A full cache becomes the one before."""
        known = {w: x for w in missing if (x := self.before.get(w)) is not None}
        new = [w for w in missing if w not in known]
        if new:
            known |= self.learn(new)
        if len(self.cache) + len(known) > self.most:
            self.before, self.cache = self.cache, {}
        self.cache |= known
        return known

    def decode(self, ids: bytes) -> bytes:
        """As the library's decode(), in UTF-8."""
        return NameMachine(self).feed(ids)


class NameMachine:
    """The library's decode(), some tokens at a time: the file names no decoder, so token names stand with one space between them. The state is whether a token came before."""

    def __init__(self, encoder: Encoder):
        self.said, self.begun = encoder.said, False

    def feed(self, ids: bytes) -> bytes:
        if not ids:
            return b""
        out = b" ".join(map(self.said.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        out, self.begun = (b" " + out if self.begun else out), True
        return out


class TextMachine:
    """Decoding to plain text, some tokens at a time: bytes wait until they end a character; a word's end gives a space, and special tokens stand as they are.

    At most three bytes wait. Bytes that are no UTF-8 become U+FFFD, as in bytes.decode(errors="replace").
    """

    def __init__(self, encoder: Encoder):
        import codecs

        self.plain, self.bytes = encoder.plain, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        return self.bytes.decode(self.plain[token], False)

    def feed_all(self, ids: bytes) -> str:
        return self.bytes.decode(b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u4").tolist())), False)

    def end(self) -> str:
        return self.bytes.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each Python worker and file; by default the public word-end vocabulary."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path(VOCABULARY))


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """For each row: key, ids (binary, little-endian unsigned 32-bit), decoded (binary, UTF-8; as the library decodes) and plain (the text as the tokens have it). No shuffle."""
    return docs.select(key, text).mapInArrow(_mapped(text, path, _Whole), f"{key} long, ids binary, decoded binary, plain string")


def _mapped(text: str, path: str | None, collector):
    """A row for each text of what a collector makes of its parts."""

    def run(batches):
        e = encoder(path)
        for batch in slices(batches, text):
            made = [collector(e) for _ in range(batch.num_rows)]
            for i, ids in e.transduce(batch.column(1).to_pylist()):
                made[i].take(ids)
            found = [m.row() for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*found, strict=True))], names=[str(i) for i in range(1 + len(found[0]))])

    return run


class _Whole:
    """All ids and both texts."""

    def __init__(self, e: Encoder):
        self.names, self.text, self.ids, self.said, self.plain = NameMachine(e), TextMachine(e), bytearray(), bytearray(), []

    def take(self, ids: bytes) -> None:
        self.ids += ids
        self.said += self.names.feed(ids)
        self.plain.append(self.text.feed_all(ids))

    def row(self) -> tuple:
        return bytes(self.ids), bytes(self.said), "".join([*self.plain, self.text.end()])


def _digest(ids: bytes, said: bytes) -> tuple[int, str, str]:
    """The query's columns of whole ids and their decoded text, which `_Digest` has without holding either."""
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said).hexdigest()


class _Digest:
    """Counts and digests, which need no part again."""

    def __init__(self, e: Encoder):
        self.names, self.text, self.n, self.letters = NameMachine(e), TextMachine(e), 0, 0
        self.ids, self.said = hashlib.sha256(), hashlib.sha256()

    def take(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.said.update(self.names.feed(ids))
        self.letters += len(self.text.feed_all(ids))

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.said.hexdigest(), self.letters + len(self.text.end())


def query(spark, sf_dir: str) -> DataFrame:
    """op6: n_tokens, digests of ids and decoded text, and code points of the plain text that the tokens stand for, for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.mapInArrow(_mapped("text", None, _Digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_plain long")
