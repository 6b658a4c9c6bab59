from __future__ import annotations

import pytest

WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "eno", "iru", "ota")]


def prose(seed: int, n: int) -> str:
    import random

    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(("", "", "", ".", ",")) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, shared passages, clashing names."""
    shared, copy = prose(1, 60), prose(2, 300)
    long = prose(3, 9000)
    texts = [prose(k, 80 + k) for k in range(10, 40)]
    rows = [(k, text, "en", f"src{k % 3}", len(text)) for k, text in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", None, "src1", 4), (103, "+ - 7 7 7", "en", None, 9)]
    rows += [(104, long, "en", "src0", 1), (105, f"{texts[0]} {shared} {texts[1]}", "en", "src1", 1), (106, f"{shared}\n{texts[2]}", "fr", "src2", 1)]
    rows += [(k, copy, "en", "src0", 1) for k in (110, 111, 112, 112, 112)] + [(None, copy, "en", "src0", 1), (None, prose(4, 90), "en", "src0", 1)]
    rows += [(113, copy.replace("a", "A", 3), "en", "src0", 1), (114, "x y x y " * 200, "en", "src0", 1), (115, "same line\n" * 50, "en", "src0", 1)]
    rows += [(116, "dèr Ñandú  groß\n\n \nend é́ 日本 <|endoftext|>", "de", "src9", 1)]
    extra = [(*row, "b", k, "d") for k, row in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket string, fp int, `copy` string"
    return spark.createDataFrame(extra, schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
