"""Small corpora for the operators on training data."""

import random

import pytest

DATA = "/root/testdata"
WORDS = "the of and to in is that it for was on with as by at from this are or an".split()


def prose(seed: int, n: int) -> str:
    random_ = random.Random(seed)
    syllables = ["ba", "co", "di", "fu", "ge", "hi", "jo", "ku", "la", "mé", "ño", "ß"]
    made = ["".join(random_.choices(syllables, k=random_.randint(1, 4))) for _ in range(n)]
    return " ".join(random_.choice(WORDS) if random_.random() < 0.3 else w for w in made)


ODD_TEXTS = [
    None, "", " ", "\n\t ", "one", "one two", "a  b", "  two  spaces  ", "\x00 nul", "tab\tand\nline",
    "日本語 の テキスト", "ﬁ ² 🙂 é", "<|endoftext|> <s> </s>", "▁ marker▁s", "x" * 3000, "ab " * 2000,
    "it's I'll we've",
]


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose with exact and near copies, shared passages, odd texts, ties and null keys."""
    passage = prose(99, 40)
    texts = [prose(i, 30 + 7 * i) for i in range(30)]
    texts += [texts[3]] * 6 + [texts[4] + " more"] * 2 + [texts[5].upper()]
    texts += [prose(200 + i, 20) + " " + passage + " " + prose(300 + i, 15) for i in range(12)]
    texts += ODD_TEXTS + ODD_TEXTS[5:9]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "again", 0), (None, texts[7], None, None, None), (None, None, "", "", 1)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )


@pytest.fixture
def empty(corpus):
    return corpus.where("false")


@pytest.fixture
def clashing(corpus):
    """The corpus with columns whose names the operators use for results and helpers."""
    names = (
        "fingerprint component_id n_tokens piece_ids decoded toxicity kept key text_hash starts ends "
        "score n_words log_likelihood main_text hash cut hit KEEP T item"
    ).split()
    import pyspark.sql.functions as F

    return corpus.withColumns({n: F.lit("mine") for n in names})
