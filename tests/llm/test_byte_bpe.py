"""The merge of one piece against merging the leftmost pair of lowest rank, one at a time."""

import random

import public_tokenizers
import pytest

from hexapla.llm import byte_bpe


def plainly(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        at = min(pairs)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("letters", [b"ab", b"etaoin shrdlu", bytes(range(256))])
def test_pieces_are_merged_lowest_rank_first(letters):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = byte_bpe.Codec(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(150):
        piece = bytes(rng.choices(letters, k=rng.randint(1, 120)))
        ids = byte_bpe.merge(piece, codec.ranks)
        assert ids == ([codec.ranks[piece]] if piece in codec.ranks else plainly(piece, codec.ranks)) and codec.decode(ids) == piece
