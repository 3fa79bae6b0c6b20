"""Token ids of whole texts with the public tokenizer files, and their counts.

``PieceEncoder`` gives exactly the ids of ``Tokenizer.encode(text,
add_special_tokens=False)``.  A byte-pair model merges inside one pre-token only,
so the ids of a text are its pre-tokens' ids in a row; pre-tokens repeat, and the
library encodes each distinct one once per worker.  The pre-token rule is applied
here only to texts whose characters all lie below U+0250, where the letter,
number and space classes are spelled out; any other text, any text that holds an
added token's string, and any tokenizer of another build goes through the
library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Unicode letters, numbers and white space below U+0250.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r \u0085\u00a0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

BYTE_LEVEL = re.compile(
    f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
WORD_LEVEL = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Characters whose class or lower case the tables above do not cover.
UNCOVERED = re.compile("[^\x00-ɏ]|[İȺȾ]")

#: Distinct pre-tokens in each of a worker's two generations; a memory bound, not a limit of the result.
REMEMBERED = 700_000
#: Texts that are cut into pre-tokens together.
TOGETHER = 64


def _kind(spec: dict) -> str:
    """Which pre-token rule a tokenizer file has: ``byte``, ``word`` or ``other``."""
    model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token"):
        return "other"
    if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"):
        return "byte"
    steps = [x["type"] for x in pre.get("pretokenizers", [])]
    norms = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix") == "</w>":
        split = pre["pretokenizers"][0]
        rule = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if split["pattern"].get("Regex") == rule and split["behavior"] == "Removed" and split["invert"]:
            return "word"
    return "other"


class PieceEncoder:
    """Encodes texts to packed little-endian ids of ``width`` bytes each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.kind = _kind(spec)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.rule = {"byte": BYTE_LEVEL, "word": WORD_LEVEL}.get(self.kind)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.kind == "byte":
            self.line_end = self.library.token_to_id("Ċ")  # the byte-level name of \n
        elif self.kind == "word":
            vocab = self.library.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None where only the library may cut it."""
        if self.rule is None or UNCOVERED.search(text) or any(a in text for a in self.added):
            return None
        return self.rule.findall(text.lower() if self.kind == "word" else text)

    def ids_by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def packed_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each pre-token on its own, many at one call.

        Pre-tokens are joined by a separator that ends a pre-token and whose trace
        in the ids is certain: the id of a line end, which no other pre-token
        holds, or the mark of a word's end.  Should the number of parts not fit,
        each is encoded alone.
        """
        blank = [p for p in pieces if p.isspace()] if self.kind == "byte" else []
        joined = [p for p in pieces if not p.isspace()] if blank else pieces
        out: dict[str, bytes] = {}
        if joined:
            text = ("\n" if self.kind == "byte" else " ").join(joined)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            if self.kind == "byte":
                at = np.flatnonzero(ids == self.line_end)
                starts, stops = np.concatenate(([0], at + 1)), np.concatenate((at, [len(ids)]))
            else:
                stops = np.flatnonzero(self.ends[ids]) + 1
                starts = np.concatenate(([0], stops[:-1]))
            if len(starts) == len(joined):
                packed = ids.tobytes()
                cuts = zip((starts * self.width).tolist(), (stops * self.width).tolist())
                if not blank:
                    return [packed[a:b] for a, b in cuts]
                out = {p: packed[a:b] for p, (a, b) in zip(joined, cuts)}
        if left := [p for p in pieces if p not in out]:
            out.update(zip(left, (i.tobytes() for i in self.ids_by_library(left))))
        return [out[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        done: list[bytes] = []
        it = iter(texts)
        while chunk := list(islice(it, TOGETHER)):
            cut = [self.pieces(t) for t in chunk]
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}
            known = self.known
            if new := set().union(*[p for p in cut if p]).difference(known):
                older = self.older
                if met := [p for p in new if p in older]:
                    known.update((p, older[p]) for p in met)
                    new.difference_update(met)
                fresh = list(new)
                known.update(zip(fresh, self.packed_pieces(fresh)))
            whole = iter(self.ids_by_library([t for t, p in zip(chunk, cut) if p is None]))
            done += [next(whole).tobytes() if p is None else b"".join(map(known.__getitem__, p)) for p in cut]
        return done


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One per worker process and tokenizer file."""
    return PieceEncoder(path)


class PieceCounter:
    """Counts tokens; only pre-tokens that are no whole token are merged.

    ``proven_whole`` is the offline part: every vocabulary string that, alone, is
    one pre-token and is encoded as one id.  Such a pre-token counts 1 wherever it
    stands.
    """

    def __init__(self, path: str, proven: frozenset[str]):
        self.path = path
        self.by_piece = path.endswith(".json")
        self.proven = proven
        self.older: dict[str, int] = {}
        if self.by_piece:
            self.enc = encoder(path)
        else:
            self.sp, self.boundary = _sentencepiece(path)
        self.known = dict.fromkeys(proven, 1)

    def count(self, texts: list[str]) -> list[int]:
        done: list[int] = []
        it = iter(texts)
        while chunk := list(islice(it, TOGETHER)):
            cut = [self.cut(t) for t in chunk]
            if len(self.known) > len(self.proven) + REMEMBERED:
                self.older, self.known = self.known, dict.fromkeys(self.proven, 1)
            known = self.known
            if new := set().union(*[p for p in cut if p]).difference(known):
                older = self.older
                if met := [p for p in new if p in older]:
                    known.update((p, older[p]) for p in met)
                    new.difference_update(met)
                fresh = list(new)
                known.update(zip(fresh, self.merge(fresh)))
            whole = iter(self.whole([t for t, p in zip(chunk, cut) if p is None]))
            done += [next(whole) if p is None else sum(map(known.__getitem__, p)) for p in cut]
        return done

    def cut(self, text: str) -> list[str] | None:
        if self.by_piece:
            return self.enc.pieces(text)
        if not self.boundary:
            return None
        return SPACED.findall(self.sp.normalize(text))

    def merge(self, pieces: list[str]) -> list[int]:
        if self.by_piece:
            return [len(i) // self.enc.width for i in self.enc.packed_pieces(pieces)]
        alone = len(self.sp.encode("a ")) - len(self.sp.encode("a"))  # of a last space, as an empty text has no token
        return [len(x) if p != "▁" else alone for p, x in zip(pieces, self.sp.encode([p[1:].replace("▁", " ") for p in pieces], num_threads=1))]

    def whole(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        if self.by_piece:
            return [len(i) for i in self.enc.ids_by_library(texts)]
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]


#: Parts of a normalised sentence-piece text: spaces and what follows them.
SPACED = re.compile("▁+[^▁]*")


@lru_cache(maxsize=4)
def _sentencepiece(path: str):
    """The processor, and whether texts may be cut before spaces.

    They may if no vocabulary string holds a space after another character, so
    that no merge reaches over the cut, if the normaliser neither drops nor
    joins spaces but sets one before the text, and if it has no strings of the
    user's own.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    closed = not any("▁" in v.lstrip("▁") for v in vocab)
    plain = sp.normalize("a  b ") == "▁a▁▁b▁" and sp.normalize("  a") == "▁▁▁a"
    return sp, closed and plain


def proven_whole(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token, as pre-tokens; bounded by the vocabulary."""
    if not path.endswith(".json"):
        sp, boundary = _sentencepiece(path)
        if not boundary:
            return frozenset()
        vocab = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        cand = [v for v in vocab if SPACED.fullmatch(v)]
        ids = sp.encode([v[1:].replace("▁", " ") for v in cand], num_threads=1)
        return frozenset(v for v, i in zip(cand, ids) if len(i) == 1)
    enc = encoder(path)
    if enc.rule is None:
        return frozenset()
    names = _byte_names()
    strings = []
    for token in enc.library.get_vocab(with_added_tokens=False):
        body = token.removesuffix("</w>") if enc.kind == "word" else token
        if enc.kind == "word" and body == token:
            continue
        try:
            strings.append(bytes(names[c] for c in body).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    cand = [s for s in strings if s and enc.pieces(s) == [s]]
    return frozenset(s for s, i in zip(cand, enc.ids_by_library(cand)) if len(i) == 1)


def _byte_names() -> dict[str, int]:
    """Byte-level vocabulary letters: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}
