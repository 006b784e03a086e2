"""The encoder against the library itself, on texts made to break its cutting."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lamellar.llm import tokens

PARTS = ["word", "the", "it's", "don't", "İ", "ı", "ß", "ﬁ", "Å", "Å", "é", "́", "̧́", "한", "ᄒ", "ᅡ", "漢字", "١٢", "½", "²", "x²", "👍🏽", "‍", "​", "﻿"]
PARTS += ["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "0", "00", "10", "3.5", ",", ".", "...", ",.", "a,", "İ,", "İ.", "é,", "ñ.", "Σ", "ΑΣ.", "_", "__", "'", "'s", "\"", "!", "?!", "\x00", "\x02", "\x1c", "\x85", " ", " ", " ", "　", "\r", "\r\n", "\t", "\x0b", "\f", "Ⅷ", "ǅ", "\U0001d11e"]
GAPS = ["", "", "", " ", " ", " ", " ", "\n", "\n", "  ", "\n\n", " \n", "\t", " ", "\r\n", "\x0b", "\x1c", "\x85", "　"]


def texts(seed, n):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        plain = rng.random() < 0.4  # single blanks alone, so that the text is cut
        made.append("".join(rng.choice(PARTS) + (rng.choice(["", " ", " ", "\n"]) if plain else rng.choice(GAPS)) for _ in range(rng.randrange(1, 12))))
    return made


def differing(name, drops_space, some, **options):
    encoder = tokens.Encoder(public_tokenizers.path(name), drops_space, **options)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    bad = []
    for lo in range(0, len(some), 500):
        ids, at = encoder.encode(pa.array(some[lo : lo + 500]))
        bad += [t for t, w, a, b in zip(some[lo : lo + 500], want[lo : lo + 500], at, at[1:]) if ids[a:b].tolist() != w]
    return bad


@pytest.mark.parametrize(("name", "drops_space"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_the_library_s(name, drops_space, seed):
    assert not differing(name, drops_space, texts(seed, 10_000), room=20 if seed == 2 else 300_000)


def test_nulls_and_empty_texts():
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    ids, at = encoder.encode(pa.array([None, "", " ", "a"], pa.string()))
    assert at.tolist() == [0, 0, 0, 0, len(ids)] and len(ids) > 0
    ids, at = encoder.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and np.asarray(at).tolist() == [0]
