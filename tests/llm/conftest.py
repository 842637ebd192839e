import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, node long, mark int"

WORDS = {
    "en": "the of and to in is that it was for with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei schön größe straße müssen können während zwischen".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Prose in two languages with copies, near copies, odd rows, and columns whose names operators use inside."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append([i, prose(rng, lang, rng.randint(1, 90)), lang, "hot" if i % 3 == 0 else f"s{i % 5}"])
    for i in range(120, 150):  # copies of one text, and near copies of another
        rows.append([i, rows[7][1] if i < 135 else " ".join(prose(random.Random(9), "en", 100).split()[: 100 - i % 3]), "en", "hot"])
    for i in range(150, 162):  # a passage that many share
        rows.append([i, prose(rng, "en", 30) + "\n" + prose(random.Random(3), "en", 40), "en", None])
    odd = ["", None, " ", "a", "12 34 !!", "ß", "😀 é\r\n\tx  y", "x" * 5000, "A b C d", "a B c D", "a b c d e"]
    rows += [[200 + i, t, None, "odd"] for i, t in enumerate(odd)]
    rows += [[5, rows[5][1], "en", "s0"]]  # a repeated row
    return spark.createDataFrame([(d, t, lang, s, None, 1, "b", 2, 3) for d, t, lang, s in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
