"""PR3, PR11: languages by character n-gram ranks: out-of-place distance of a text's trigrams to a profile of each language.

A text's trigrams are counted within its row (sorted, and runs measured), ranked and cut to the MOST most frequent; they meet
the profiles in a broadcast join and a row's distances are summed where it lies, so what is shuffled is a row a text. Profiles are
ranks of trigrams in sample texts: SAMPLES for ten languages, or any labelled rows. Texts in kana or mostly in Han are named by
their script, which trigrams of a small sample cannot tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trigrams of a profile and of a text that count; a trigram that a profile lacks is that far out of place.
MOST = 300
#: The fewest characters of a text that are judged.
SHORTEST = 30
#: A text is undetermined where the best language leads by less than this share of the largest distance.
MARGIN = 0.004
UNDETERMINED = "und"
#: ---- fixed values: articles 1 and 3 of the Universal Declaration of Human Rights, and common words of each language ----
SAMPLES = {
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Das ist nicht ein Haus, aber ich habe es auch für dich und die Kinder gemacht, weil wir heute nach der Arbeit zu den Freunden gehen.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. This is not the house that we have seen, but when they come from work you can ask what there is to do for the children.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Esta no es la casa que hemos visto, pero cuando vienen del trabajo se puede preguntar lo que hay que hacer para los niños.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Ce n'est pas la maison que nous avons vue, mais quand ils viennent du travail on peut demander ce qu'il y a à faire pour les enfants.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Questa non è la casa che abbiamo visto, ma quando vengono dal lavoro si può chiedere che cosa c'è da fare per i bambini.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. Dit is niet het huis dat wij hebben gezien, maar als ze van het werk komen kun je vragen wat er voor de kinderen te doen is.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Esta não é a casa que nós vimos, mas quando eles vêm do trabalho pode-se perguntar o que há para fazer com as crianças.",
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Это не тот дом, который мы видели, но когда они придут с работы, можно спросить, что надо сделать для детей.",
}
KANA, HAN, LETTER = r"[぀-ヿ]", r"[㐀-䶿一-鿿]", r"\p{L}"
#: ---- end of fixed values ----


def _grams(text: str) -> str:
    """The trigrams of a whole text, sorted: letters in lower case, all else a space, one at a time and at either end."""
    letters = f"' ' || trim(regexp_replace(lower({text}), '[^\\\\p{{L}}]+', ' ')) || ' '"
    return f"sort_array(regexp_extract_all({letters}, '(?=(...)).', 1))"


def _counted(grams: str) -> str:
    """Sorted trigrams as (minus their number, trigram): sorted, the most frequent come first and ties by trigram.

    Equal ones stand side by side, so one pattern over all of them in a row cuts them to runs; a function of each would be interpreted."""
    runs = f"regexp_extract_all(array_join({grams}, ''), '(...)\\\\1*', 0)"
    return f"sort_array(transform({runs}, r -> struct(-cast(length(r) / 3 AS int) AS minus, substring(r, 1, 3) AS gram)))"


def profiles(labelled: DataFrame) -> DataFrame:
    """(lang, gram, place) of labelled texts (lang, text): the MOST most frequent trigrams of each language, from 1."""
    rows = labelled.where("lang IS NOT NULL").select("lang", F.expr(_grams("coalesce(text, '')")).alias("g")).select("lang", F.expr(f"explode({_counted('g')})").alias("c"))
    counts = rows.groupBy("lang", F.col("c.gram").alias("gram")).agg(F.sum(-F.col("c.minus")).alias("n"))
    placed = counts.withColumn("place", F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)"))
    return placed.where(F.col("place") <= MOST).select("lang", "gram", "place")


def sample_profiles(spark: SparkSession) -> DataFrame:
    return profiles(spark.createDataFrame(sorted(SAMPLES.items()), "lang string, text string"))


def detect(df: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """(key, lang, score) of each row: the nearest language or `und`, and one minus its share of the largest distance.

    Rows that share a key are one text's; known: profiles(), else those of SAMPLES. Undetermined are texts under SHORTEST characters,
    without letters, without a trigram of any profile, or with two languages nearly as near. A null text is undetermined."""
    from loomstone.plans.compile import hold

    known = hold(sample_profiles(df.sparkSession) if known is None else known)  # worked out once, though looked at twice
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    wide = known.groupBy("gram").agg(*(F.max(F.when(F.col("lang") == lang, F.col("place"))).alias(f"p{i}") for i, lang in enumerate(langs)))  # MOST rows a language at most
    t = f"coalesce({text}, '')"
    mostly = lambda p, times: f"({t} RLIKE '{p}' AND regexp_count({t}, '{p}') * {times} >= regexp_count({t}, '{LETTER}'))"
    script = f"CASE WHEN {mostly(KANA, 10)} THEN 1 WHEN {mostly(HAN, 2)} THEN 2 ELSE 0 END"  # a number, which is aggregated without sorting
    rows = df.select(F.col(key), F.expr(f"length({t}) >= {SHORTEST}").alias("enough"), F.expr(script.replace(chr(92), chr(92) * 2)).alias("script"), F.expr(_grams(t)).alias("g"))
    ranked = rows.select(key, "enough", "script", F.expr(f"posexplode_outer(slice({_counted('g')}, 1, {MOST}))").alias("at", "c")).select(key, "enough", "script", (F.col("at") + 1).alias("rank"), F.col("c.gram").alias("gram"))
    far = lambda i: F.sum(F.coalesce(F.least(F.abs(F.col("rank") - F.col(f"p{i}")), F.lit(MOST)), F.lit(MOST))).alias(f"d{i}")
    sums = ranked.join(F.broadcast(wide), "gram", "left").groupBy(key).agg(F.first("enough").alias("enough"), F.expr("CASE first(script) WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' END").alias("script"), F.count("rank").alias("n"), *map(far, range(len(langs))))
    order = F.array_sort(F.array(*(F.struct(F.col(f"d{i}").alias("d"), F.lit(lang).alias("lang")) for i, lang in enumerate(langs)))) if langs else F.lit(None).cast("array<struct<d: long, lang: string>>")
    found = sums.select(key, "enough", "script", (F.col("n") * MOST).alias("most"), order.alias("o"))
    clear = F.expr(f"enough AND most > 0 AND o[0].d < most AND (size(o) = 1 OR o[1].d - o[0].d >= {MARGIN} * most)") if langs else F.lit(False)
    lang = F.when(F.col("enough") & F.col("script").isNotNull(), F.col("script")).when(clear, F.expr("o[0].lang")).otherwise(F.lit(UNDETERMINED))
    score = F.when(F.col("enough") & F.col("script").isNotNull(), F.lit(1.0)).otherwise(F.expr("CASE WHEN most > 0 THEN 1 - o[0].d / most ELSE 0.0 END") if langs else F.lit(0.0))
    return found.select(key, lang.alias("lang"), F.round(score, 6).alias("score"))


def source_language(df: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """PR3: (key, language): Portuguese where its signals prevail clearly, else what detect() finds of Portuguese, English and Spanish
    in the first 4,000 characters, else by the weaker signals, else unknown."""
    from loomstone.functions import text as T
    from loomstone.functions.dialect import SPARK as D

    sample = df.select(F.col(key), F.expr(f"substring(coalesce({text}, ''), 1, 4000)").alias("lm_t"))
    hits = sample.select(key, F.expr(T.portuguese_hits(D, "lm_t")).alias("pt"), F.expr(T.english_hits(D, "lm_t")).alias("en"))
    own = detect(sample, key, "lm_t", known).select(key, "lang")
    picked = F.expr("CASE WHEN pt >= 3 AND pt > en THEN 'pt-BR' WHEN lang = 'pt' THEN 'pt-BR' WHEN lang IN ('en', 'es') THEN lang WHEN pt > en AND pt >= 1 THEN 'pt-BR' WHEN en > 0 THEN 'en' ELSE 'unknown' END")
    return hits.join(own, key).select(key, picked.alias("language"))
