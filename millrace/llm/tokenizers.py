"""Public tokenizers from local vocabulary files."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

FOLDER = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
#: The public pattern that splits text before the merges of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: name: library and file.
FILES = {
    "byte_bpe_50k": ("tiktoken", "byte_bpe_50k.tiktoken"),
    "byte_bpe_multi_50k": ("tiktoken", "byte_bpe_multi_50k.tiktoken"),
    "word_bpe_49k": ("tokenizers", "word_bpe_49k.json"),
    "piece_bpe_32k": ("sentencepiece", "piece_bpe_32k.model"),
}
#: Characters from which a text is cut up, and those of white space at one place from which the run is a piece of its own.
LONG, LONG_SPACE = 1 << 16, 1 << 12
#: White space as the pattern's engine has it (fixed value): the characters with that property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Ranks:
    """A rank file's byte-level encoding; it has no special tokens, so their strings are ordinary text. Made anew in each task, which takes a fifth of a second."""

    def __init__(self, name: str, folder: str = FOLDER):
        import tiktoken

        path = os.path.join(folder, FILES[name][1])
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        make = lambda pattern: tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.text, self.piece = make(PATTERN), make("(?s).+")


def cut_points(text: str, most: int = LONG) -> list[int]:
    """Places at which the text can be cut without a token changing: between a character that is no white space and a plain space or line feed.

    The pattern's pieces hold white space only at their start or alone, and its one look-ahead looks past white space only, so every such place parts two pieces.
    A stretch without such a place stays whole.
    """
    cuts, at = [0], 0
    safe = re.compile(r"(?<=\S)[ \n]")
    while len(text) - at > most:
        m = safe.search(text, at + most)
        if not m:
            break
        cuts.append(at := m.start())
    return [*cuts, len(text)]


def _apart(text: str) -> list[tuple[str, bool]]:
    """The text as parts, and whether a part is one long piece of white space: a run of any kinds of it without its last character, which goes with what follows.

    The pattern's engine gives up on very long runs, as it has to step back over them; it would take each for one piece as well.
    """
    out, at = [], 0
    for m in re.finditer(f"[{WHITE}]{{{LONG_SPACE},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += [(text[at : m.start()], False), (text[m.start() : end], True)]
        at = end
    return [*out, (text[at:], False)]


def encode(ranks: Ranks, text: str | None) -> list[int]:
    """Token ids without special tokens; none for null and for empty text. Equal to encoding the whole text at once, and never more than the library can take at once."""
    if not text:
        return []
    if len(text) <= LONG:
        return ranks.text.encode_ordinary(text)
    out: list[int] = []
    cuts = cut_points(text)
    for a, b in zip(cuts, cuts[1:], strict=False):
        for part, alone in _apart(text[a:b]):
            out += (ranks.piece if alone else ranks.text).encode_ordinary(part)
    return out


def decode(ranks: Ranks, ids: list[int]) -> str:
    """The text of the ids, by joining their raw bytes; a token alone may hold part of a character."""
    return b"".join(map(ranks.text.decode_single_token_bytes, ids)).decode("utf-8", "replace")


def counter(name: str, folder: str = FOLDER) -> Callable[[list[str | None]], list[int]]:
    """A function from texts to their numbers of tokens, for any of FILES; null and empty texts have none."""
    library, file = FILES[name]
    path = os.path.join(folder, file)
    if library == "tiktoken":
        e = Ranks(name, folder)
        return lambda texts: [len(encode(e, t)) for t in texts]
    if library == "tokenizers":
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path)
        words.encode_special_tokens = True

        def count(texts: list[str | None]) -> list[int]:
            out = [0] * len(texts)
            short = [(i, t) for i, t in enumerate(texts) if t and len(t) <= LONG]
            for (i, _), x in zip(short, words.encode_batch([t for _, t in short], add_special_tokens=False), strict=True):
                out[i] = len(x.ids)
            for i, t in enumerate(texts):  # white space parts words here too
                if t and len(t) > LONG:
                    cuts = cut_points(t)
                    out[i] = sum(len(words.encode(t[a:b], add_special_tokens=False).ids) for a, b in zip(cuts, cuts[1:], strict=False))
            return out

        return count
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in p.encode([x or "" for x in texts], num_threads=1)]
