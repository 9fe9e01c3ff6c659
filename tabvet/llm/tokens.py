"""Token ids of whole texts with a byte-level BPE vocabulary of the tokenizers library."""

from __future__ import annotations

import re
from functools import lru_cache

_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
#: A line break beside white space or at an end.
_BREAK = re.compile(r"\s\n|\n\s|^\n|\n$")
#: Marks that are cut off a word's end: after a letter a run of them is a piece of its own.
MARKS = ".,!*$&%#|?;:"
PART_CACHE, WORD_CACHE = 50_000, 300_000
BATCH_CHARS = 4_000_000
#: Beyond, a batch (one huge text) is not put into one Arrow array.
ARROW_CHARS = 64_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(a) -> list[str]:
    """An Arrow array of strings as a list; ``to_pylist`` makes a scalar of each first."""
    return a.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes.

    The vocabulary's splitter always ends a piece before a single space between
    two other characters, around a single line break, and between a letter and a
    run of marks; and pieces are merged on their own.  So the ids of a text are
    those of its parts in a row.  Arrow finds the distinct parts of a batch and puts
    their ids in the order of the texts.  The library merges each distinct word once; words
    are kept in caches of bounded size, of which the older half goes when they fill.
    A text with the string of an added token goes to the library as a whole.  With
    ``special`` those of special tokens are such too, as by the library's default;
    without it they are ordinary text.
    """

    def __init__(self, path: str, end_id: int | None, special: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.merge = self.tokenizer.model.tokenize
        # the splitter's characters for bytes, as it gives them for each byte alone
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        text = "".join(map(chr, range(0x80))) + "".join(map(chr, range(0x80, 0x800))) + "\u0800\u1000\u2000\u3000\u4000\u5000\u6000\u7000\u8000\u9000\ua000\ub000\uc000\ud000\ue000\uf000"
        text += "".join(map(chr, (0x10000, 0x50000, 0x90000, 0xD0000, 0x100000)))
        self.letters = dict(zip(text.encode(), "".join(x for x, _ in spell(text))))
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts = Parts(self, ""), Parts(self, " ")
        self.words = Words(self, ""), Words(self, " ")
        self.marks = {"": b""}
        self.newline = self._merged("\n")

    def _merged(self, w: str) -> bytes:
        """Ids of one piece."""
        spelled = w.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.raw[t.id] for t in self.merge(spelled)])

    def _marks(self, w: str) -> bytes:
        ids = self.marks.get(w)
        if ids is None:
            ids = self._merged(w)
            if len(self.marks) < PART_CACHE:
                self.marks[w] = ids
        return ids

    def part(self, p: str, lead: str) -> bytes | None:
        """Ids of a part between spaces; None where white space meets a space."""
        head = p.rstrip(MARKS)
        ids = self.words[lead == " "][head]
        if ids is not None:  # a piece, and marks that are another
            return ids + self._marks(p[len(head) :])
        if not p or p[0].isspace() or p[-1].isspace():
            return None
        if "\n" in p and not _BREAK.search(p):
            one, *more = p.split("\n")
            return self.part(one, lead) + b"".join([self.newline + self.part(q, "") for q in more])
        return self._whole(lead + p)

    def _whole(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _distinct(self, parts) -> list[bytes | None]:
        """``part`` of distinct parts after a space, an Arrow array: a word is looked up once, whatever marks follow it."""
        import numpy as np
        import pyarrow.compute as pc

        heads = pc.utf8_rtrim(parts, MARKS)
        coded = heads.dictionary_encode()
        spaced, rest, marks = self.words[1], self.parts[1], self.marks
        found = np.empty(len(coded.dictionary), object)
        found[:] = [spaced[w] for w in _strings(coded.dictionary)]
        out = found[coded.indices.to_numpy()]
        none = np.equal(out, None).astype(bool)
        cut = pc.binary_length(parts).to_numpy() > pc.binary_length(heads).to_numpy()
        rows = np.flatnonzero(cut & ~none)
        for k, p, n in zip(rows.tolist(), _strings(parts.take(rows)), pc.utf8_length(heads).to_numpy()[rows].tolist()):
            tail = p[n:]
            out[k] += marks[tail] if tail in marks else self._marks(tail)
        rows = np.flatnonzero(none)
        for k, p in zip(rows.tolist(), _strings(parts.take(rows))):
            out[k] = self._lines(p) if "\n" in p else rest[p]
        return out.tolist()

    def _lines(self, p: str) -> bytes | None:
        """``part`` after a space, of words with line breaks between."""
        dicts, found, lines = self.words, b"", p.split("\n")
        for k, q in enumerate(lines):
            head = q.rstrip(MARKS)
            ids = dicts[k == 0][head]
            if ids is None:
                return self.parts[1][p]
            found += (self.newline if k else b"") + ids + self._marks(q[len(head) :])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        for x in (*self.words, *self.parts):
            x.age()
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if any(a in t for a in self.added):
                out[k] = self._whole(t) + self.end
            else:
                plain.append(k)
        if sum(len(texts[k]) for k in plain) <= ARROW_CHARS:
            for k, ids in zip(plain, self._spread([texts[k] for k in plain])):
                out[k] = ids
        for k in plain:
            if out[k] is None:
                out[k] = self._alone(texts[k])
        return out

    def _spread(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts; None for a text in which white space meets a space."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = split.values.dictionary_encode()
        begin = split.offsets.to_numpy()
        ids = self._distinct(coded.dictionary)
        ids += [self.part(t.split(" ", 1)[0], "") for t in texts]  # no space before the first
        at = coded.indices.to_numpy().astype(np.int32)
        at[begin[:-1]] = np.arange(len(ids) - len(texts), len(ids), dtype=np.int32)
        odd = np.array([x is None for x in ids], bool)
        bad = np.logical_or.reduceat(odd[at], begin[:-1]) if len(texts) else np.empty(0, bool)
        joined = pa.array([x or b"" for x in ids], pa.binary()).take(pa.array(at))
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(at) + 1, 4 * joined.offset)[begin].tolist()
        data = joined.buffers()[2]
        data = data.to_pybytes() if data is not None else b""
        return [None if x else data[a:b] + self.end for x, a, b in zip(bad.tolist(), ends, ends[1:])]

    def _alone(self, t: str) -> bytes:
        first, rest = self.parts
        s = t.split(" ")
        try:
            return first[s[0]] + b"".join([rest[p] for p in s[1:]]) + self.end
        except TypeError:  # a part is None
            s = _BETWEEN_WORDS.split(t)
            return self._whole(s[0]) + b"".join([rest[p] or self._whole(" " + p) for p in s[1:]]) + self.end


class Aging(dict):
    """What is missing is found, or taken from the older half."""

    def __init__(self, coder: Encoder, lead: str, size: int) -> None:
        super().__init__()
        self.coder, self.lead, self.size, self.old = coder, lead, size, {}

    def __missing__(self, p: str) -> bytes | None:
        old = self.old
        self[p] = ids = old[p] if p in old else self.find(p)
        return ids

    def age(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class Parts(Aging):
    """Ids by part."""

    def __init__(self, coder: Encoder, lead: str) -> None:
        super().__init__(coder, lead, PART_CACHE)

    def find(self, p: str) -> bytes | None:
        return self.coder.part(p, self.lead)


class Words(Aging):
    """Ids by word; None for what is not letters alone."""

    def __init__(self, coder: Encoder, lead: str) -> None:
        super().__init__(coder, lead, WORD_CACHE)

    def find(self, w: str) -> bytes | None:
        return self.coder._merged(self.lead + w) if w.isalpha() else None


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path, end_id, special=True)


def encoded(ids: list, texts: list[str], path: str, end_id: int | None):
    """Pairs of id and encoded text, a bounded number of characters at a time."""
    enc, start, chars = encoder(path, end_id), 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= BATCH_CHARS or k == len(texts) - 1:
            yield from zip(ids[start : k + 1], enc.encode(texts[start : k + 1]))
            start, chars = k + 1, 0
