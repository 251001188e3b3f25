"""Languages of more letters than the table of the automata has columns."""

import numpy as np
from test_text_ops import brute_phrases

from orrery.llm import langid


def drawn(rng, first, letters, n):
    """n words over so many letters from a code point on, rare letters as likely as frequent ones."""
    words = ["".join(chr(first + int(i)) for i in rng.integers(0, letters, rng.integers(2, 5))) for _ in range(letters)]
    return " ".join(words[i] for i in rng.integers(0, letters, n))


def test_cross_parsing_of_many_letters():
    rng = np.random.default_rng(3)
    texts = {"aa": drawn(rng, 0x4E00, 900, 1500), "bb": drawn(rng, 0x4E00 + 450, 900, 1500), "cc": drawn(rng, 0xAC00, 900, 1500), "dd": "banana bandana cabana"}
    model = langid.CrossParser({k: [v] for k, v in texts.items()})
    learned = {k: v + " " for k, v in texts.items()}
    assert len(model.alphabet) > 4 * langid.DENSE and model.symbols == len(model.alphabet) + 2
    mixed = [t[at : at + 300].strip() for t in texts.values() for at in (0, 500, 2000) if t[at : at + 300].strip()] + ["banana 一丁 滿志 zzz"]
    for text in mixed:
        text = "".join(map(chr, langid.fold(text)))
        want = [brute_phrases(text, learned[lang]) for lang in model.langs]
        assert model.phrases([langid.fold(text)]).tolist() == [want]


def test_languages_of_rare_letters_are_told_apart():
    rng = np.random.default_rng(5)
    first = {"en": (0x61, 26), "zh": (0x4E00, 2000), "ko": (0xAC00, 2000), "am": (0x1200, 60)}
    model = langid.CrossParser({k: [drawn(rng, *v, 1500)] for k, v in first.items()})
    texts = {k: drawn(np.random.default_rng(9), *v, 200) for k, v in first.items()}
    assert dict(zip(texts, model.predict(list(texts.values()))[0], strict=True)) == {k: k for k in texts}
    unseen = "".join(chr(0x0E01 + i) for i in range(40))
    assert model.phrases([langid.fold(unseen)]).tolist() == [[40] * 4]
