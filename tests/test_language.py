"""Languages by trigram ranks: ten codes, what is undetermined, held-out documents."""

import pytest

from loomstone.operators import language as L

SAID = {
    "de": "Die Katze schläft auf dem Sofa, während der Hund im Garten mit den Kindern spielt und niemand zu Hause ist.",
    "en": "The weather was so cold that nobody wanted to leave the house, although the shops were open until late.",
    "es": "El perro duerme en el jardín mientras los niños juegan con la pelota que les regaló su abuela ayer.",
    "fr": "Le chien dort dans le jardin pendant que les enfants jouent avec la balle que leur grand-mère a achetée.",
    "it": "Il cane dorme nel giardino mentre i bambini giocano con la palla che la nonna ha comprato per loro ieri.",
    "nl": "De hond slaapt in de tuin terwijl de kinderen met de bal spelen die hun oma gisteren voor hen heeft gekocht.",
    "pt": "O cachorro dorme no jardim enquanto as crianças brincam com a bola que a avó comprou para elas ontem.",
    "ru": "Собака спит в саду, пока дети играют с мячом, который вчера купила для них бабушка, и никого нет дома.",
    "ja": "犬は庭で寝ています。子供たちは昨日おばあさんが買ってくれたボールで遊んでいます。家には誰もいません。",
    "zh": "狗在花园里睡觉，孩子们在玩祖母昨天给他们买的球，家里没有人，天气很好，大家都很高兴，晚上一起吃饭。",
}
NONE = {"short": "The house is not", "digits": "1234567890 " * 9, "blank": " " * 80, "null": None, "greek": "ΑΒΓ ΔΕΖ ΗΘΙ ΚΛΜ ΝΞΟ ΠΡΣ ΤΥΦ ΧΨΩ ΑΒΓ ΔΕΖ"}


def test_ten_codes(spark):
    df = spark.createDataFrame([*SAID.items(), *NONE.items()], "k string, t string")
    got = {r["k"]: (r["lang"], r["score"]) for r in L.detect(df, "k", "t").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: k for k in SAID} | dict.fromkeys(NONE, "und")
    assert all(0 <= s <= 1 for _, s in got.values()) and got["greek"][1] == 0 and got["null"][1] == 0


def test_close_languages_are_undetermined(spark, monkeypatch):
    df = spark.createDataFrame([*SAID.items()], "k string, t string")
    monkeypatch.setattr(L, "MARGIN", 0.9)
    assert {r["lang"] for r in L.detect(df, "k", "t").collect()} == {"und", "ja", "zh"}


def test_source_language(spark):
    rows = [("a", SAID["pt"]), ("b", SAID["en"]), ("c", SAID["es"].replace("í", "i").replace("ñ", "n").replace("ó", "o")), ("d", SAID["nl"]), ("e", "para isso"), ("f", "the end"), ("g", None), ("h", "Não está pronto, porque não há tempo para isso.")]
    got = {r["k"]: r["language"] for r in L.source_language(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got == {"a": "pt-BR", "b": "en", "c": "es", "d": "unknown", "e": "pt-BR", "f": "en", "g": "unknown", "h": "pt-BR"}


def test_whole_texts_count(spark):
    """What a text says after its first page counts, in its own trigrams and in the profiles."""
    long = spark.createDataFrame([("k", L.SAMPLES["de"] * 8 + L.SAMPLES["en"] * 40)], "k string, t string")
    assert [r["lang"] for r in L.detect(long, "k", "t").collect()] == ["en"]
    labelled = spark.createDataFrame([("a", "abc " * 1000 + "qwx " * 2000), ("b", SAID["en"])], "lang string, text string")
    assert {r["gram"]: r["place"] for r in L.profiles(labelled).where("lang = 'a'").collect()}["qwx"] <= 4


@pytest.mark.parametrize("size", ["sf0.01"])
def test_held_out_documents(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    got = L.detect(docs.where("doc_id % 4 = 2"), "doc_id", "text", L.profiles(docs.where("doc_id % 4 <> 2"))).join(docs.select("doc_id", docs["lang"].alias("own")), "doc_id").where("own IS NOT NULL AND lang <> 'und'")
    right = got.where("lang = own").count() / got.count()
    assert right > 0.97, right
