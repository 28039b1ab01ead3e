"""Token ids of whole texts for a byte-level ``tokenizers`` file.

The vocabulary is read from the file. Texts are encoded by tiktoken's engine over that vocabulary, several
times as fast as the file's own; on loading, both engines encode a probe text and have to agree. Strings
of the file's special tokens in a text are ordinary text (``encode_special_tokens`` in ``tokenizers``), or get the
ids of these tokens, as ``tokenizers`` does by default, if ``special_as_text`` is false.
"""

from __future__ import annotations

import os

import numpy as np
import tiktoken

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # that of the byte-level pre-tokenizer
_PROBE = "It's 12 o'clock,  isn't it?\n\n\tÜber naïve 日本語 🙂 x²—(a+b)*c == 'we''ll' <|endoftext|> " + " ".join(chr(c) for c in range(33, 1500))


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TextEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = special_as_text
        byte_of, added = _byte_of(), model.get_added_tokens_decoder()
        special = {t.content: i for i, t in added.items()}
        if any(not t.special or t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError(f"{path} has added tokens that match otherwise than by their plain strings")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model.get_vocab(with_added_tokens=False).items() if token not in special}
        self.engine = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={} if special_as_text else special)
        if np.frombuffer(self.encode([_PROBE])[0], "<u4").tolist() != model.encode(_PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a byte-level vocabulary of the known kind")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(self.engine.encode_to_numpy(t, allowed_special="all", disallowed_special=()), "<u4").tobytes() for t in texts]
