"""Words of scripts without spaces."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake import cli
from sessionlake.functions import text as X
from sessionlake.functions.segment import Dictionary, spaced

THAI = "ตา\t5\nตาก\t4\nกลม\t6\nลม\t5\nแมว\t3\nกิน\t8\nปลา\t8\n# none\n\nข้าว"
KHMER = ["ខ្ញុំ", "ស្រឡាញ់", "ភាសា", "ខ្មែរ"]


@pytest.fixture()
def thai():
    X.use_dictionary(Dictionary.read(THAI.split("\n")))
    yield X._dictionary
    X.use_dictionary(None)


def test_words_cost_least():
    d = Dictionary.read(THAI.split("\n"))
    assert list(d.words("แมวกินปลา")) == ["แมว", "กิน", "ปลา"]
    assert list(d.words("ตากลม")) == ["ตา", "กลม"]  # of ตา|กลม and ตาก|ลม the more frequent words
    assert list(d.words("แมวฮฮฮกินฮ")) == ["แมว", "ฮฮฮ", "กิน", "ฮ"]
    assert list(Dictionary(KHMER).words("ខ្ញុំស្រឡាញ់ភាសាខ្មែរ")) == KHMER
    assert list(Dictionary([]).words("กข")) == ["กข"] and d.spaced("a b") == "a b"
    assert Dictionary(["ก", "ข"]).digest == Dictionary(["ข", "ก"]).digest != Dictionary(["ก"]).digest


def test_against_all_cuts():
    rng = random.Random(3)
    d = Dictionary([("ก", 1), ("กข", 5), ("ขค", 5), ("คก", 2), ("กขค", 1), ("ข", 1)])
    for _ in range(40):
        run = "".join(rng.choice("กขคง") for _ in range(rng.randint(1, 9)))
        price = lambda parts: sum(d.costs.get(p, d.unknown * len(p)) for p in parts)
        cuts = [[run[a:b] for a, b in zip([0, *c], [*c, len(run)])] for n in range(len(run)) for c in itertools.combinations(range(1, len(run)), n)]
        best = min(map(price, cuts))
        assert abs(price(list(d.words(run))) - best) < 1e-9 and "".join(d.words(run)) == run


def test_index_and_query_agree(spark, thai):
    texts = ["แมวกินปลา ok", "x ตากลม", None, "plain", "แมวฮฮกิน部署"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["x"] for r in df.select("i", X.fts_tokens(F.col("t")).alias("x")).orderBy("i").collect()]
    for t, x in zip(texts, got):
        assert (x is None) == (t is None) and (t is None or x == [w for term in X.level1(t) for w in X.term_tokens(term)])
    assert X.query_terms("แมวกิน") == ["แมว", "กิน"]
    assert spark.range(1).select(spaced(F.lit("แมวกิน"), None)).first()[0] == "แมวกิน"


def test_index_tells_its_dictionary(spark, tmp_path, capsys):
    folder = tmp_path / "s" / "2024" / "01" / "02"
    folder.mkdir(parents=True)
    row = {"timestamp": "2024-01-02T00:00:00Z", "type": "event_msg", "payload": {"type": "user_message", "message": "เห็นแมวกินปลา"}}
    (folder / "rollout-2024-01-02T00-00-00-00000000-0000-4000-8000-000000000001.jsonl").write_text(json.dumps(row))
    (tmp_path / "words").write_text(THAI)
    try:
        call = lambda *words: (cli.main(["--index", str(tmp_path / "ix"), "--json", *words], spark), capsys.readouterr())
        with_words = ("--dictionary", str(tmp_path / "words"))
        assert call(*with_words, "sync", "--selector", json.dumps({"kind": "all", "root": str(tmp_path / "s")}))[0] == 0
        assert len(json.loads(call(*with_words, "find", "กิน ปลา")[1].out)["results"]) == 1
        code, out = call("find", "กิน")
        assert code == 1 and "another dictionary" in out.err
    finally:
        X.use_dictionary(None)
