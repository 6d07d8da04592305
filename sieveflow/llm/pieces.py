"""Piece vocabularies of public SentencePiece files, read without training anything."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

SPACE = "▁"
#: Default path of the vocabulary, a parameter everywhere.
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces (piece -> id, piece -> score), the 256 byte pieces, the score of each of these, and the longest piece."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: tuple[int, ...]
    unknown: float
    longest: int
    surface: dict[int, bytes] = field(repr=False, default_factory=dict)
    #: Every prefix of an ordinary piece: its (score, ids) if it is one itself, else None.
    prefixes: dict[str, tuple[float, tuple[int, ...]] | None] = field(repr=False, default_factory=dict)


@lru_cache(maxsize=4)
def load(path: str = PIECE_FILE) -> Vocabulary:
    """The vocabulary in a model file. Spaces are U+2581 in pieces; bytes stand for other characters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ranks, by, surface = {}, {}, {}, {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            by[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[piece], ranks[piece] = i, -float(sp.get_score(i))
            surface[i] = piece.replace(SPACE, " ").encode()
    if len(by) != 256:
        raise ValueError(f"{path} has no byte pieces")
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError(f"{path} has pieces with a space after other characters")
    scores, byte = zipf(ids, ranks)
    prefixes: dict = {p[:i]: None for p in ids for i in range(1, len(p))}
    prefixes |= {p: (scores[p], (i,)) for p, i in ids.items()}
    return Vocabulary(ids, scores, tuple(by[i] for i in range(256)), byte, max(map(len, ids)), surface, prefixes)


@lru_cache(maxsize=4)
def log_weights(path: str = PIECE_FILE) -> tuple[dict[str, float], float]:
    """Natural-log weights of pieces as a unigram vocabulary, and that of a byte.

    The file ranks its pieces (its scores are minus the rank), so a piece of rank r weighs
    1 / (r + 10), Zipf's law.
    """
    v = load(path)
    return v.scores, v.unknown


def zipf(ids: dict[str, int], ranks: dict[str, float]) -> tuple[dict[str, float], float]:
    """Natural logs of 1 / (r + 10) for rank r, normalised; all 256 bytes come after the last rank.

    They are rounded to 2^-20, so that sums of them are exact and don't depend on the order of adding.
    """
    ranked = sorted(ids, key=lambda p: (ranks[p], ids[p]))
    raw = [1 / (r + 10) for r in range(len(ranked) + 256)]
    total = math.fsum(raw)
    log = lambda w: round(math.log(w / total) * 2**20) / 2**20
    return {p: log(w) for p, w in zip(ranked, raw, strict=False)}, log(raw[-1])
