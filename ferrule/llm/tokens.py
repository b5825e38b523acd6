"""Token ids of whole texts by a vocabulary file of the tokenizers library.

For vocabularies whose normaliser drops white space and whose pre-tokeniser
never joins across it, a text's ids are the ids of its blank-separated words one
after the other.  Words repeat, so each worker keeps the ids of words it has seen
and calls the library for new ones only.  A new word is looked up once more in lower
case and without the marks at its end, whose ids follow those of the rest.  Words
of letters alone go straight to the library's merges, as their normalising and
splitting change nothing; all others take its whole path.

Whether a vocabulary is of that kind is read from its file: normaliser, splitting
and model must be exactly those below, and added tokens must be matched in the
text as it is.  Any other vocabulary encodes whole texts.  A text that holds the
string of an added token, which the library takes for that token, is always
encoded whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable
from itertools import compress, repeat
from operator import is_

import numpy as np

#: Words kept by one worker, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 900_000, 48
#: Texts that are looked up before new words are encoded.
GROUP = 50
#: The normaliser, splitting and settings of the model for which words stand alone.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
#: ``str.split`` cuts at these too, the library does not.
_NO_BLANKS = "\x1c\x1d\x1e\x1f"
#: A run of these after a letter is one slice of the text (an apostrophe may begin a contraction).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = np.dtype(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.cache: dict[str, bytes] = {}
        self.letters = str.maketrans(self._byte_letters())
        self.packed = [n.tobytes() for n in np.arange(self.library.get_vocab_size(), dtype=self.type)]
        parts = json.loads(self.library.to_str())
        added = parts["added_tokens"]
        self.added = [t["content"] for t in added]
        self.by_word = (
            parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _SPLITTING and parts["post_processor"] is None and parts["truncation"] is None and parts["padding"] is None
            and all(t[k] == v for t in added for k, v in _ADDED.items()) and all(parts["model"][k] == v for k, v in _MODEL.items())
        )

    @staticmethod
    def _byte_letters() -> dict[int, int]:
        """The characters that byte-level vocabularies write bytes as: printable ones are
        themselves, the others follow on from 256 in order."""
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in shown]
        return {b: 256 + k for k, b in enumerate(others)}

    @staticmethod
    def split(text: str) -> list[str]:
        if text.isascii() and not any(c in text for c in _NO_BLANKS):
            return text.split()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words by the library's whole path: each word is one pre-split input."""
        if not words:
            return {}
        found = self.library.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        flat = np.array(found.ids, dtype=self.type).tobytes()
        size = self.type.itemsize
        cuts = (np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(words) + 1)) * size).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, cuts, cuts[1:])}

    def _ids_of(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of new words, by their stems where a word is letters and at most one final mark."""
        others, found, marks = [], {}, {"": b""}
        get, tokenize, packed, letters = self.cache.get, self.library.model.tokenize, self.packed, self.letters
        for word in words:
            stem = word.rstrip(_MARKS)
            mark = word[len(stem) :]
            if not stem.isalpha():
                others.append(word)
                continue
            low = stem.lower()
            if low.isascii():
                plain = low
            elif "Σ" in stem or not low.isalpha() or not unicodedata.is_normalized("NFC", low):
                others.append(word)  # capital sigma has two small forms, and marks may combine
                continue
            else:
                plain = low.encode().decode("latin-1").translate(letters)
            ids = found.get(low) or get(low)
            if ids is None:
                ids = b"".join([packed[t.id] for t in tokenize(plain)])
                found[low] = ids
            if mark not in marks:
                marks[mark] = self._whole(mark)
            if mark or low is not word:
                found[word] = ids + marks[mark]
        found |= self._new_words(others)
        return found

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as packed integers of ``type``; a null text has none."""
        texts = list(texts)
        if not self.by_word:
            return [self._whole(t) if t else b"" for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        # Small groups, as a word that is new to one group is known to the next.
        return [ids for at in range(0, len(texts), GROUP) for ids in self._encode_group(texts[at : at + GROUP])]

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        cache, out, lacking, new = self.cache, [], [], set()
        get = cache.get
        for text in texts:
            if text and any(a in text for a in self.added):
                out.append([self._whole(text)])
                continue
            words = self.split(text) if text else []
            ids = list(map(get, words))
            # Comparing by identity never looks into the ids.
            gaps = list(compress(range(len(ids)), map(is_, ids, repeat(None))))
            if gaps:
                new.update([words[at] for at in gaps])
                lacking.append((words, ids, gaps))
            out.append(ids)
        if new:
            found = self._ids_of(new)
            for words, ids, gaps in lacking:
                for at in gaps:
                    ids[at] = found[words[at]]
            cache.update([(w, ids) for w, ids in found.items() if len(w) <= CACHE_CHARS])
        return [b"".join(ids) for ids in out]


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker for the vocabulary at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
