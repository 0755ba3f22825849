"""Work of the encoder and of the packing that grew with repeats."""

import random

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm import binary, packing


def test_a_pre_token_is_looked_up_once_a_batch():
    """op12, op9: not once for each of its places; the ids are the library's."""

    class Counted(dict):
        looked = 0

        def get(self, *key):
            self.looked += 1
            return super().get(*key)

    encode, model = binary.Encoder(binary.public()), Tokenizer.from_file(binary.public())
    encode.words = Counted()
    many = ["to be  or not\n to be, 12" * 50, "", " ", "\n", "to ", "é×", "don't", "to be "] * 20
    assert [np.frombuffer(g, "<u4").tolist() for g in encode(many)] == [model.encode(t, add_special_tokens=False).ids for t in many]
    assert 0 < encode.words.looked < 40
    encode.KEEP = 1  # kept pre-tokens are let go
    assert [encode([t]) for t in many[:5]] == [[g] for g in encode(many[:5])]


def test_bins_are_counted_by_sizes():
    """op12: a branch is bounded without placing pieces one by one."""
    rng = random.Random(8)
    for _ in range(300):
        capacity = rng.randint(3, 90)
        counts = np.bincount([rng.randint(1, capacity) for _ in range(rng.randint(0, 80))], minlength=capacity + 1)
        assert packing.best_fit_bins(counts, capacity) == len(packing.best_fit(counts, capacity))
