import random

from quillmesh.llm.names import BANDED, RECALL, _banding, band_keys, collision, grams, pair_keys, parse


def _error(rng, w):
    i = rng.randrange(len(w) - 1)
    c = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]))


def test_bands_meet_as_surely_as_the_collision_curve_says():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    met = apart = 0
    for _ in range(300):
        words = [word(rng.randint(7, 10)) for _ in range(4)]
        other = [_error(rng, words[0]), *words[1:]]
        met += bool(band_keys(grams(words)) & band_keys(grams(other)))
        apart += not band_keys(grams(words)) & band_keys(grams([word(8), word(8), word(9), words[3]]))
    assert met >= 299 and apart >= 299
    for n in range(BANDED, 200):
        assert collision((n - 3) / (n + 3), *_banding(n)) >= RECALL


def test_long_forms_have_bands_and_no_key_that_leaves_a_word_out():
    a = pair_keys(parse("Pazobilil Centre for Forest Management"), {}, {})
    assert a and all(k.startswith("b") for k, _ in a)
    # given names as one of their group, all but the one that may have an error
    b, c = parse("Alexander Bartholomaus Featherstonehaugh"), parse("Alex Bartholomaus Featherstonehuagh")
    assert pair_keys(b, {}, {}) & pair_keys(c, {}, {})


def test_repeated_grams_count_each():
    assert len(grams(["anna", "anna"])) == 10
