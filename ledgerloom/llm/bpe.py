"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

The encoder finds, with an Aho-Corasick automaton, the longest vocabulary token at every position of a word. It takes
the longest token that fits after the previous one and steps back where none does. Two tokens fit when no merge across
their border comes before the merges that built them; then the sequence is exactly what merging by rank gives, and each
position is given up at most once, so the work is linear in the word for a bounded token length.

The vocabulary is a tokenizers JSON file of the kind "word ends": NFC, white space to one space, lower case, pieces by
pattern, bytes as printable letters, last letter of a piece with an end mark.

Cases: null and empty texts have no tokens and decode to the empty text; special tokens standing in a text are found
before normalisation, as the tokenizers library does; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import Recent, batch, map_batches, table, tokenizer_file

#: Entries of each generation of the memo of pieces, and most token pairs remembered.
PIECES, PAIRS = 300_000, 500_000
#: Documents decoded together (as one gather through the offset table), in tokens.
DECODE_TOKENS = 2_000_000
#: Letters whose case and category no Unicode version of the last decades changed.
_FAMILIAR = re.compile("[\t-\r -~\u00a0-\u017f]*")
#: Their letters and numbers, as the categories L and N have them.
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible Latin-1, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class BpeVocabulary:
    """Merges, token texts and the tables of the encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len)[::-1])) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = re.compile(pattern.replace(r"[\p{L}]", f"[{_LETTERS}]").replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS))
        self.letters = byte_letters()
        self.letter_of = {b: c for b, c in enumerate(self.letters)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            token = vocab[left + right]
            pair = (vocab[left], vocab[right])
            self.merge[pair] = rank
            self.parts[token], self.rank[token] = pair, rank
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        texts = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.specials.items()}}
        # The end mark is one more symbol of the word, and so of the tokens that end one.
        self.mark = "￿"
        symbols = {
            i: s[: -len(self.end)] + self.mark if self.end and s.endswith(self.end) else s for s, i in vocab.items()
        }
        self.width = {i: len(s) for i, s in symbols.items()}
        self.automaton = ahocorasick.Automaton()
        for token, s in symbols.items():
            if self.reachable(token):
                self.automaton.add_word(s, token)
        self.automaton.make_automaton()
        by_text = {s: i for i, s in symbols.items() if self.reachable(i)}
        self.shorter = {
            i: next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), None)
            for s, i in by_text.items()
        }
        # Decoder: all token texts, each followed by one space, and where each begins.
        size = max(texts) + 1
        encoded = [(texts.get(i, "") + " ").encode() for i in range(size)]
        self.buffer = np.frombuffer(b"".join(encoded), np.uint8)
        self.lengths = np.array([len(x) for x in encoded], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    # Pair compatibility

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank at which it is merged away) down one edge of ``token``."""
        memo = self._left if side == 0 else self._right
        if token not in memo:
            out, gone, at = [], float("inf"), token
            while True:
                out.append((at, gone))
                if at not in self.parts:
                    break
                gone, at = self.rank[at], self.parts[at][side]
            memo[token] = out
        return memo[token]

    def _crosses(self, a: int, b: int, before: float) -> bool:
        """Whether a merge over the border of ``a`` and ``b`` comes first; merges from rank ``before`` on don't count.

        Walks the pairs that face each other at the border, in the order in which merges replace them. Of equal merges
        the left one goes first: it must beat the merge inside ``a`` and may tie with that inside ``b``.
        """
        lefts, rights, merge = self._spine(a, 1), self._spine(b, 0), self.merge
        i, j = len(lefts) - 1, len(rights) - 1
        left, left_gone = lefts[i]
        right, right_gone = rights[j]
        while True:
            limit = left_gone if left_gone <= right_gone else right_gone + 0.5
            rank = merge.get((left, right))
            if rank is not None and rank < limit and rank < before:
                return True
            if left_gone <= right_gone:
                if not i:
                    return False
                i -= 1
                left, left_gone = lefts[i]
            else:
                j -= 1
                right, right_gone = rights[j]

    def fits(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[a, b] = not self._crosses(a, b, float("inf"))
        return known

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own text gives the token."""
        if token not in self.rank:
            return True
        a, b = self.parts[token]
        return self.reachable(a) and self.reachable(b) and not self._crosses(a, b, self.rank[token])

    # Encoder

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one piece in byte letters (without its end mark)."""
        text = word + self.mark if self.end else word
        # The last letter and the mark are one symbol: no token ends between them.
        longest: dict[int, int] = {}
        width, known = self.width, self._fits
        for stop, token in self.automaton.iter(text):
            longest[stop + 1 - width[token]] = token  # for one start, later matches are longer
        out: list[int] = []
        dead: set[int] = set()
        at, n, token, last = 0, len(text), longest.get(0), None
        while at < n:
            while token is not None:
                if at + width[token] not in dead:
                    if last is None:
                        break
                    fit = known.get((last, token))
                    if fit or fit is None and self.fits(last, token):
                        break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += width[token]
                last, token = token, longest.get(at)
            else:
                dead.add(at)
                token = out.pop()  # the first position can't be given up: single letters always fit
                last = out[-1] if out else None
                at -= width[token]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of one piece: a special token's text, or a word of the pattern."""
        if piece in self.specials:
            return [self.specials[piece]]
        return self.encode_word(piece.encode().decode("latin-1").translate(self.letter_of))

    def split(self, text: str) -> list[str]:
        """Normalised pieces of a text, special tokens among them as they stand."""
        if "<|" not in text and _FAMILIAR.fullmatch(text):
            return self.pieces.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        # Beyond Latin the categories depend on the Unicode version: ask the library's own normaliser and splitter.
        back = {c: b for b, c in self.letter_of.items()}
        out: list[str] = []
        for chunk in _WHITE.split(text):
            for part in self.special_split.split(chunk):
                if part in self.specials:
                    out.append(part)
                elif "<|" not in part and _FAMILIAR.fullmatch(part):
                    out += self.pieces.findall(unicodedata.normalize("NFC", part).lower())
                elif part:
                    plain = self.library.normalizer.normalize_str(part)
                    cut = self.library.pre_tokenizer.pre_tokenize_str(plain)
                    out += [bytes(back[c] for c in word).decode() for word, _ in cut]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(piece)]

    # Decoder

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Texts of the documents whose ids are ``ids[bounds[i]:bounds[i + 1]]``: token texts joined by one space."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        steps = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        out = self.buffer[steps + np.arange(len(steps))].tobytes()
        cut = np.concatenate([[0], ends])[bounds]
        return [out[a : max(a, b - 1)] for a, b in zip(cut, cut[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].decode()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = BpeVocabulary(path)
        memo = Recent(vocabulary.encode_piece, PIECES)
        for rows in batches:
            ids = [[i for p in vocabulary.split(t) for i in memo[p]] if t else [] for t in rows.column(1).to_pylist()]
            yield batch(doc_id=rows.column(0), ids=(ids, pa.list_(pa.int32())))

    return map_batches(docs.select("doc_id", "text"), task, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode and digest every row: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = BpeVocabulary(path)

        width = np.dtype(np.uint16 if len(vocabulary.lengths) <= 65536 else np.uint32)

        def known(piece: str) -> tuple[bytes, bytes]:
            ids = vocabulary.encode_piece(piece)
            return np.array(ids, width).tobytes(), "".join(f"{i} " for i in ids).encode()

        memo = Recent(known, PIECES)
        for rows in batches:
            counts, ids_sha, text_sha = [], [], []
            raw: list[bytes] = []
            pending = 0

            def flush() -> None:
                bounds = np.concatenate([[0], np.cumsum([len(x) // width.itemsize for x in raw])]).astype(np.int64)
                ids = np.frombuffer(b"".join(raw), width)
                text_sha.extend(hashlib.sha256(x).hexdigest() for x in vocabulary.decode_all(ids, bounds))
                raw.clear()

            for text in rows.column(1).to_pylist():
                found = [memo[p] for p in vocabulary.split(text)] if text else []
                raw.append(b"".join([x for x, _ in found]))
                counts.append(len(raw[-1]) // width.itemsize)
                ids_sha.append(hashlib.sha256(b"".join([x for _, x in found])[:-1]).hexdigest())
                pending += counts[-1]
                if pending >= DECODE_TOKENS:
                    flush()
                    pending = 0
            flush()
            yield batch(
                doc_id=rows.column(0),
                n_tokens=(counts, pa.int64()),
                ids_sha256=(ids_sha, pa.string()),
                decoded_sha256=(text_sha, pa.string()),
            )

    return map_batches(
        docs.select("doc_id", "text"), task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
