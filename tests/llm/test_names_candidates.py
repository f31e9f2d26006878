import itertools
import random

from quillmesh.llm.names import SAME, compare, link_names, pair_keys, parse


def _meet(values):
    """Pairs of values that share a key, and those that compare() accepts."""
    forms = [parse(v) for v in values]
    codes, initials = {}, {}
    for w, s, i in forms:
        codes.setdefault(len(w) + len(s), set()).update(x[:2] for x in s)
        if i:
            initials[len(w) + len(s)] = max(len(i), initials.get(len(w) + len(s), 0))
    keys = [pair_keys(f, codes, initials) for f in forms]
    turned = [{(k, (0, 2, 1)[n]) for k, n in x} for x in keys]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if forms[i] != forms[j]]
    accepted = [(values[i], values[j]) for i, j in pairs if compare(forms[i], forms[j])[0] >= SAME]
    return {(values[i], values[j]) for i, j in pairs if keys[i] & turned[j]}, accepted


def test_every_accepted_pair_shares_a_key():
    rng = random.Random(5)
    words = "robert bob rob bert wang wagn wnag smith smtih garcia gracia kumar kumra li lee chris christopher kit international intl. int. university univ. uni. business bus. busines r. b. k. l. c. s. w. j. u. i.".split()
    values = sorted({" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 2, 3, 3, 4, 5)))) for _ in range(1500)})
    met, accepted = _meet(values)
    assert len(accepted) > 500 and not [p for p in accepted if p not in met]


def test_names_of_common_words_are_linked(spark):
    letters = "bcdfghjklmnpqrstvwz"
    made = [a + "a" + b + "o" + c + "u" + d for a, b, c, d in itertools.product(letters[:6], letters[6:12], letters[12:], "nrst")]
    filler = [f"{w.title()} {s}" for s in ("Xumarov", "Zelinkar") for w in made[:400]] + [f"{g} {w.title()}" for g in ("Robert", "Bob") for w in made[:150]]
    same = ["Robert Xumarov", "Bob Xumarov", "R. Xumarov"]
    got = {r.value: r.cluster for r in link_names(spark.createDataFrame([(v,) for v in filler + same * 3], "author string")).collect()}
    assert len({got[v] for v in same}) == 1


def test_short_words_with_an_error_and_single_words_are_linked(spark):
    pairs = [("Tariq Wang", "Tariq Wagn"), ("Ulla Smith", "Ulla Smtih"), ("Ines Garcia", "Ines Gracia"), ("Oto Meyer", "Oto Mayer"), ("Farmwatch", "Farmwacth"), ("Telekom", "TELEKON")]
    filler = [f"{g} {w}{x}" for g in ("Tariq", "Ulla", "Ines", "Oto") for w in ("Bron", "Velt", "Dask") for x in itertools.islice(map("".join, itertools.product("aeiou", repeat=3)), 40)]
    got = {r.value: r.cluster for r in link_names(spark.createDataFrame([(v,) for v in filler + [v for p in pairs for v in p]], "author string")).collect()}
    assert all(got[a] == got[b] for a, b in pairs)
