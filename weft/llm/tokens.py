"""Token ids of whole texts, with a memory for the pieces that recur.

Both kinds of vocabulary split a text into pieces that are encoded on their
own, and no piece crosses from white space to a word. A text is cut at such
places and every piece that a worker doesn't remember yet is encoded by the
tokenizers library.
"""

from __future__ import annotations

import re
import sys
from array import array
from os.path import commonprefix
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weft.llm.common import ENCODERS, append_columns, release_memory

#: White space of the byte-level pattern, as a character class.
_WHITE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Ends a piece of a byte-level vocabulary: white space and the word behind it.
_CUT = "\0"
#: Letters that neither normalisation nor lower case turns into several.
_LETTERS = "A-Za-zß-öø-ÿÀ-ÖØ-Þ"
#: Pieces that can be encoded next to others and told apart again, by kind of
#: vocabulary: words without apostrophes, or one white space and a word.
_PLAIN_WORD = re.compile(f"[{_LETTERS}0-9!-&(-/:-@[-`{{-~]+")
_PLAIN_BYTES = re.compile(r"[ \n][^\s\x1c-\x1f]+")
#: Pieces that are one pre-token of the vocabulary's pattern: the model takes them as they are.
_LETTERS_ONLY = re.compile(f" ?[{_LETTERS}]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: The sign of each byte in a vocabulary, as a code point: printable bytes stand for themselves, the others follow 255.
_BYTE_SIGNS = np.arange(256, dtype="<u4")
_HIDDEN = np.r_[0:33, 127:161, 173]
_BYTE_SIGNS[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
#: Pieces of either generation that a worker remembers, of a word vocabulary and
#: of a byte-level one (its pieces hold the white space too), and the longest such piece.
REMEMBERED, LONGEST = {True: 400_000, False: 250_000}, 64
#: Bytes of text that are looked up together, and plain pieces encoded in one call.
_TOGETHER, _JOINED = 1 << 20, 2000


class Encoder:
    """Encodes whole texts to the bytes of arrays of ids, of type self.dtype.

    Texts are cut in pieces and distinct pieces looked up; ids are gathered by
    array operations. With special_tokens, the name of one in a text is that
    token, as the library has it; without, it is ordinary text, so that no
    document can set one. Null and empty texts have no ids.
    """

    def __init__(self, path: str, special_tokens: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special_tokens
        self._model = self._tokenizer.model
        added = self._tokenizer.get_added_tokens_decoder().values() if special_tokens else ()
        self._names = [t.content for t in added]
        self._name_start = commonprefix(self._names)
        vocabulary = self._tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        kind = str(self._tokenizer.pre_tokenizer)
        # Word vocabularies drop white space: words alone carry the ids.
        self._words = "Split" in kind
        if not self._words and "use_regex=True" not in kind:
            raise ValueError("unknown kind of tokenizer: its pieces can't be told")
        # One token of each part of a plain word has the word end; the first
        # token of a plain byte-level piece has the white space.
        self._edge = np.zeros(max(vocabulary.values()) + 1, bool)
        edge = (lambda t: t.endswith("</w>")) if self._words else (lambda t: t[0] in "ĠĊ")
        self._edge[[i for t, i in vocabulary.items() if edge(t)]] = True
        # When the younger generation is full, it replaces the older one; what
        # is met again comes back from there.
        self._memory: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces of letters: the model gets what normalisation and the pattern would leave of each."""
        joined = "|".join(pieces)
        data = np.frombuffer((joined.lower() if self._words else joined).encode(), np.uint8)
        spelt = _BYTE_SIGNS[data].tobytes().decode("utf-32-le").split("|")
        kind, model = self.dtype.char, self._model.tokenize
        return [array(kind, [t.id for t in model(p)]).tobytes() for p in spelt]

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """The ids of plain pieces, encoded in one call, or each if the ids can't be told apart."""
        data = self._encode((" " if self._words else "").join(pieces))
        ids = np.frombuffer(data, self.dtype)
        edges = np.flatnonzero(self._edge[ids])
        counts = [1 if p.isalpha() else len(_PARTS.findall(p)) for p in pieces] if self._words else 1
        parts = np.cumsum(np.broadcast_to(counts, len(pieces)))
        if len(edges) != parts[-1]:
            return list(map(self._encode, pieces))
        cuts = np.r_[0, edges[parts - 1] + 1] if self._words else np.r_[edges, len(ids)]
        cuts = (cuts * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _unknown(self, pieces: list[str]) -> None:
        """Encode pieces that are not remembered."""
        letters = list(filter(_LETTERS_ONLY.fullmatch, pieces))
        if letters:
            self._memory.update(zip(letters, self._letters(letters), strict=True))
        rest = set(pieces).difference(letters)
        plain = list(filter((_PLAIN_WORD if self._words else _PLAIN_BYTES).fullmatch, rest))
        for at in range(0, len(plain), _JOINED):
            part = plain[at : at + _JOINED]
            self._memory.update(zip(part, self._plain(part), strict=True))
        rest.difference_update(plain)
        self._memory.update(zip(rest, map(self._encode, rest), strict=True))

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self._memory.get, pieces))
        places = [n for n, ids in enumerate(found) if ids is None]
        if len(self._memory) + len(places) > REMEMBERED[self._words]:
            self._memory, self._older = {}, self._memory
            places = range(len(pieces))
        new = [pieces[n] for n in places]
        memory = self._memory
        if self._older:
            known = list(map(self._older.get, new))
            memory.update((p, ids) for p, ids in zip(new, known, strict=True) if ids is not None)
            unknown = [p for p, ids in zip(new, known, strict=True) if ids is None]
        else:
            unknown = new
        self._unknown(unknown)
        for n, piece in zip(places, new, strict=True):
            found[n] = memory[piece]
        for p in unknown:
            if len(p) > LONGEST:
                del memory[p]
        return found

    def _split(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text; empty ones stand for nothing."""
        marks = f"([{_LETTERS}])([.,;:!?|])"
        if self._words:
            # A mark is a word of its own behind letters, and case does not count.
            return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), marks, r"\1 \2"))
        cut = pc.replace_substring_regex(texts, marks, f"\\1{_CUT}\\2")
        # Before a lone space or line end is a cut; runs of white space need their whole context.
        runs = pc.match_substring_regex(cut, f"[{_WHITE}][ \n]")
        lone = pc.if_else(runs, "", cut)
        for white in (" ", "\n"):
            lone = pc.replace_substring(lone, white, _CUT + white)
        rest = pc.replace_substring_regex(pc.if_else(runs, cut, ""), f"([{_WHITE}]*[^{_WHITE}{_CUT}]+)", f"\\1{_CUT}")
        return pc.split_pattern(pc.if_else(runs, rest, lone), _CUT)

    def _whole(self, texts: pa.Array) -> pa.Array:
        """Whether a text is to be encoded in one piece; such ones are rare."""
        whole = pc.match_substring(texts, _CUT)
        if self._names and pc.any(pc.match_substring(texts, self._name_start, ignore_case=self._words)).as_py():
            for name in self._names:
                whole = pc.or_(whole, pc.match_substring(texts, name, ignore_case=self._words))
        return whole

    def _gather(self, texts: pa.Array, end: bytes) -> pa.Array:
        lists = self._split(texts)
        coded = lists.flatten().dictionary_encode()
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        del lists
        table = pa.array([*self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), end], pa.binary())
        order = np.insert(coded.indices.to_numpy(), ends, len(table) - 1)
        del coded
        pieces = table.cast(pa.large_binary()).take(pa.array(order))
        # The ids lie one behind the other: texts are cut behind their ends.
        _, starts, ids = pieces.buffers()
        cuts = np.frombuffer(starts, np.int64, len(pieces) + 1)[np.r_[0, ends + np.arange(1, len(ends) + 1)]]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts), ids])

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text, and the end id if there is one, as a binary array."""
        close = b"" if end is None else np.array([end], self.dtype).tobytes()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        parts, at = [], 0
        while at < len(texts):
            stop = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TOGETHER)) + 1
            part = texts[at:stop]
            whole = self._whole(part)
            ids = self._gather(pc.if_else(whole, "", part), close)
            if pc.any(whole).as_py():
                chosen = zip(whole.to_pylist(), part, ids, strict=True)
                ids = pa.array([self._encode(t.as_py()) + close if w else i.as_py() for w, t, i in chosen], pa.large_binary())
            parts.append(ids)
            at = stop
            release_memory()  # else what is freed here stays with the worker
        return pa.concat_arrays(parts).cast(pa.binary()) if parts else pa.array([], pa.binary())


def encoder(path: str, special_tokens: bool = True) -> Encoder:
    """The encoder of this worker process for a vocabulary file."""
    held = sys.modules.setdefault(ENCODERS, ModuleType(ENCODERS))
    key = f"{path} {special_tokens}"
    if key not in held.__dict__:
        held.__dict__[key] = Encoder(path, special_tokens)
    return held.__dict__[key]


def with_ids(
    docs: DataFrame, path: str, end_id: int, text: str = "text", name: str = "ids", special_tokens: bool = True
) -> DataFrame:
    """docs with the ids of each whole text and end_id, as little-endian bytes.

    Names of special tokens in a text are these tokens, or else ordinary text. Ids take two bytes if the vocabulary fits, else four; see id_type().
    """

    def make():
        encode = encoder(path, special_tokens).encode
        return lambda column: [encode(column, end_id)]

    return append_columns(docs, [text], make, f"{name} binary")


def id_type(path: str) -> np.dtype:
    """The type of the ids that with_ids() writes."""
    return Encoder(path).dtype
