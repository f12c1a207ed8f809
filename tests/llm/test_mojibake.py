import math

import numpy as np
import pytest

from brindle.llm import mojibake

CLEAN = ["Der Prüflauf überspringt die Größe der Bäume.", "Le château répète la fenêtre — même à vide.", "Индекс читает имена функций до начала поиска.", "索引は検索の前に全ての経路を確認する。空の目録は毎回見出しの値を書き直す。"]


@pytest.fixture(scope="module")
def restored(spark):
    """doc_id -> restored text of a corpus with the texts as documents from 1000."""

    def run(*texts):
        rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(60)] + [(1000 + i, t) for i, t in enumerate(texts)]
        return {r.doc_id: r.restored for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}

    return run


def test_once(restored):
    steps = [(0, "utf-8", "cp1252"), (0, "cp1252", "cp1251"), (1, "cp1252", "mac-roman"), (2, "cp1251", "koi8-r"), (2, "utf-8", "cp866")]
    texts = [mojibake.garble(CLEAN[k], ((a, b),)) for k, a, b in steps]
    got = restored(*texts)
    assert sorted(got) == [1000 + i for i in range(len(steps))]
    assert got[1000] == CLEAN[0]
    assert got[1001] == CLEAN[0]


def test_lost_characters_and_parts(restored):
    text = CLEAN[0] + " " + CLEAN[0].encode("cp1252").decode("utf-8", "replace")
    assert set(restored(text)) == {1000}


def test_no_cases(restored):
    quoted = "A reader typed `Größe` and saw `GrÃ¶ÃŸe` on the page."
    spoken = "It showed GrÃ¶ÃŸe where Größe was meant."
    assert restored(quoted, spoken, "It gave `“ok”` and `â€œokâ€\x9d`.", "a lone � marks a byte nobody could read", "MAÇÃ «É» 3 µm Å", "cafe\u0301", "", None) == {}


def test_empty_table(spark):
    assert mojibake.garbled(spark.createDataFrame([], "doc_id bigint, text string")).isEmpty()


@pytest.mark.parametrize("k, chain", [
    (2, (("utf-8", "cp1252"), ("utf-8", "cp1251"))),
    (2, (("utf-8", "cp437"), ("utf-8", "latin-1"), ("utf-8", "cp1252"))),
    (0, (("utf-8", "cp1252"), ("cp1252", "cp1251"))),
    (3, (("utf-8", "cp1252"),)),
    (3, (("utf-8", "latin-1"), ("utf-8", "latin-1"))),
    (3, (("cp932", "cp1252"),)),
    (3, (("utf-8", "gbk"),)),
    (3, (("euc-jp", "gbk"),)),
])
def test_chains(restored, k, chain):
    assert set(restored(mojibake.garble(CLEAN[k], chain))) == {1000}


def test_string_in_code_and_lost_sign(restored):
    lines = 'x = "' + mojibake.garble("Größe", (("utf-8", "cp1252"),)) + '";', "Le château \ufffd même."
    assert set(restored(*lines)) == {1000, 1001}


def test_no_pair_is_left_out(restored, monkeypatch):
    """Few of the corpus's characters and pairs would fit under a cap."""
    monkeypatch.setattr(mojibake, "PAIRS", 1, raising=False)
    chains = [(2, (("utf-8", "cp1252"), ("utf-8", "cp1251"))), (3, (("utf-8", "cp1252"),)), (3, (("euc-jp", "gbk"),))]
    assert sorted(restored(*(mojibake.garble(CLEAN[k], c) for k, c in chains))) == [1000, 1001, 1002]


def test_weight_is_that_of_all_pairs():
    count = {"検索": 7, "索の": 3, "é ": 5, "aé": 4}
    keys = sorted((mojibake._pair(*p), n) for p, n in count.items())
    known = mojibake.Known({}, *np.array(keys, np.int64).T)
    for text in ("検索の前", "caé b", "plain", "", "\0é"):
        own = [count.get(text[i : i + 2], 0) for i in range(len(text) - 1) if not text[i : i + 2].isascii()]
        assert known.weight(text) == (sum(math.log2(1 + x) for x in own) / len(own) if own else 0.0)
    none = np.zeros(0, np.int64)
    assert mojibake.Known({}, none, none).weight("検索") == 0.0
