import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tricky_rows():
    """Nulls, empty and very long texts, repeats, near copies, odd white space and characters."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = sentence(60)
    long_text = sentence(9000)
    texts = [None, "", " \n\t ", "one", "One", "two words", long_text, long_text, passage, f"{sentence(30)} {passage} {sentence(20)}", f"{passage}\n{passage}", "é" * 150 + "ü" * 150,
             "x" * 700, "\x00\x0b odd\x1fwhite space  ", "Straße ÉCOLE naïve <|endoftext|> it's 42!!", "hH̱ ẖ İI", passage.upper()]
    texts += [sentence(r.randrange(1, 120)) for _ in range(40)]
    near = sentence(400).split()
    for k in range(6):
        changed = list(near)
        changed[37 * k] = "changed"
        texts.append(" ".join(changed))
    rows = [(i, t, "en", "s", None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (3, "another text under a known id", "en", "s", 1), (None, "no id at all", None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(tricky_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(tricky):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "id th h g ring salt rows digest fp text_crc32 size shard slot cell kind chunk part words positions n_tokens score piece start length rank label kept keep_id component_id".split()
    return tricky.select("*", *(F.lit(1).alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    return __import__("public_tokenizers").path("word_bpe_49k.json")
