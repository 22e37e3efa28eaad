"""Fees recorded in different currencies, scales and periods, converted to common units.

Where currency, scale and period are stated (in the currency column or in words of the note) they are read; where the
currency is missing, a calibrated forest predicts it from magnitude, source, category and neighbouring fields, and only
confident assignments are converted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkademia.session import Workspace

# How currencies are written, as regular expressions over the lower-cased text, in order of precedence.
CURRENCY_WORDS = [
    ("AUD", r"\bk?aud\b|au ?\$|\ba ?\$|\baus(tralian)? dollar"),
    ("CAD", r"\bk?cad\b|ca ?\$|\bc ?\$|\bcdn|canadian dollar"),
    ("BRL", r"\bk?brl\b|r ?\$|\breais\b|\breal\b|centavo"),
    ("GBP", r"\bk?gbp\b|\bukp\b|£|\bpounds?\b|\bpence\b|\bpenny\b|^p$|sterling"),
    ("EUR", r"\bk?eur(o|os|ocents?)?\b|€"),
    ("JPY", r"\bk?jpy\b|\byen\b|円|¥|￥"),
    ("PLN", r"\bk?pln\b|zł|zlot|grosz"),
    ("USD", r"\bk?usd\b|us ?\$|us dollar|us cent|dollar|\$"),
]
# Scales of the currency text and of the note.
CURRENCY_SCALES = [
    (10000.0, r"万|10 ?k\b|10[,.]?000"),
    (1000.0, r"千|thousand|'?000|\bk\b|[£$€¥]k$|^k(usd|eur|gbp|aud|cad|pln|brl|jpy)|tys\.|tsd|^t ?(€|eur)|^mil "),
    (0.01, r"cent|pence|penny|^p$|grosz"),
]
NOTE_SCALES = [
    (10000.0, r"万円|10[,.]?000"),
    (1000.0, r"千|thousand|'000|[x×] ?1[,.]?000\b|\bin k\b|tsd|tys\.|\bmilhares\b|\bmiles\b|milliers"),
    (0.01, r"minor unit|hundredth|1/100|\bcents\b|\bpence\b"),
]
# Words for periods. A length in figures or words goes before them; longer words before those they contain.
_UNIT_MONTH = r"(?:months?|monate?n?|mois|meses|mês|mes|miesi\w+|か月|カ月|ヶ月|ヵ月|箇月)"
_UNIT_YEAR = r"(?:years?|jahre?n?|années?|ans|an|años|año|anos|ano|lata?|年間|年)"
LENGTH_MONTHS = rf"([0-9]+) ?-?{_UNIT_MONTH}"
LENGTH_YEARS = rf"([0-9]+) ?-?{_UNIT_YEAR}"
PERIOD_WORDS = [
    (2, r"every two months|alle zwei monate|tous les deux mois"),
    (3, r"every three months|alle drei monate|tous les trois mois|cada tres meses|cada três meses"),
    (4, r"every four months|alle vier monate|tous les quatre mois|cada cuatro meses|cada quatro meses"),
    (6, r"every six months|alle sechs monate|tous les six mois|cada seis meses"),
    (3, r"quarter|vierteljähr|quartal|四半期|par trimestre|por trimestre|al trimestre|trimestral|trimestriel|kwarta"),
    (4, r"trimester|every term\b"),
    (6, r"half-? ?year|halbjähr|semest|/ ?sem|半期|半年|学期"),
    (1, r"month|/ ?mo\b|\bpcm\b|monat|\bmois\b|\bmes\b|\bmês\b|mensual|mensal|mensuel|月額|毎月|miesi"),
    (12, r"annum|annual|p\. ?a\.|year|/ ?yr|par an\b|al año|por ano|por año|\banual|annuel|jähr|pro jahr|年額|年間|roczn"),
]
TYPE_MONTHS = {"fixed_month": 1, "fixed_semester": 6, "fixed_year": 12}
NOT_A_PERIOD_PRICE = r"per[_ ]credit|per[_ ]course|per[_ ]module|\brange\b|range_"
PIECE_TYPES = ("range", "per_credit", "per_course")


def _first_match(text: Column, table, otherwise: Column | None = None) -> Column:
    out = otherwise if otherwise is not None else F.lit(None)
    for value, pattern in reversed(table):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def stated_currency(currency: Column, note: Column) -> Column:
    """ISO code by the currency text, else by the note; null where neither names one."""
    c, n = F.lower(F.trim(F.coalesce(currency, F.lit("")))), F.lower(F.coalesce(note, F.lit("")))
    return F.coalesce(_first_match(c, CURRENCY_WORDS), _first_match(n, CURRENCY_WORDS))


def stated_scale(currency: Column, note: Column) -> Column:
    """Whole units in one unit of the amount, by the currency text, else by the note; 1 where neither says."""
    c, n = F.lower(F.trim(F.coalesce(currency, F.lit("")))), F.lower(F.coalesce(note, F.lit("")))
    return F.coalesce(_named_scale(c, n), F.lit(1.0))


def _named_scale(c: Column, n: Column) -> Column:
    return F.coalesce(_first_match(c, CURRENCY_SCALES), _first_match(n, NOTE_SCALES))


def scale_is_open(currency: Column, note: Column) -> Column:
    """Whether nothing states the scale: a currency that is named without one counts in whole units, so only where neither
    currency nor scale is named."""
    c, n = F.lower(F.trim(F.coalesce(currency, F.lit("")))), F.lower(F.coalesce(note, F.lit("")))
    return stated_currency(currency, note).isNull() & _named_scale(c, n).isNull()


def stated_months(tuition_type: Column, note: Column) -> Column:
    """Months that the amount pays for: a length in the note, else its words, else the tuition type; null for ranges,
    prices per credit or course, totals without a length, and where nothing is said."""
    n = F.lower(F.coalesce(note, F.lit("")))
    length = F.coalesce(
        F.nullif(F.regexp_extract(n, LENGTH_MONTHS, 1), F.lit("")).try_cast("int"),
        F.nullif(F.regexp_extract(n, LENGTH_YEARS, 1), F.lit("")).try_cast("int") * 12,
    )
    words = F.coalesce(F.nullif(length, F.lit(0)), _first_match(n, PERIOD_WORDS))
    by_type = F.lit(None).cast("int")
    for name, value in TYPE_MONTHS.items():
        by_type = F.when(F.lower(F.trim(tuition_type)) == name, F.lit(value)).otherwise(by_type)
    return F.when(piece_price(tuition_type, note), F.lit(None)).otherwise(F.coalesce(words, by_type)).cast("int")


def piece_price(tuition_type: Column, note: Column) -> Column:
    """Whether the amount is a range or a price per credit, course or module, which pays for no period."""
    n = F.lower(F.coalesce(note, F.lit("")))
    return n.rlike(NOT_A_PERIOD_PRICE) | F.coalesce(F.lower(F.trim(tuition_type)).isin(*PIECE_TYPES), F.lit(False))


def pattern_sources(program_map: DataFrame, programs: DataFrame, universities: DataFrame) -> DataFrame:
    """(pattern_id, country, programs): the country most of a pattern's programmes are in. Counts are taken per pattern
    and university before the universities are joined, so a pattern used by a third of all programmes is small."""
    m = program_map.select(F.col("degree_program_id").alias("p"), F.col("tuition_pattern_id").alias("pattern_id"))
    p = programs.select(F.col("id").alias("p"), F.col("university_id").alias("u"))
    u = universities.select(F.col("id").alias("u"), F.upper(F.trim(F.col("country"))).alias("country"))
    counts = m.join(p, "p").groupBy("pattern_id", "u").agg(F.count(F.lit(1)).alias("n"))
    by_country = counts.join(u, "u").where(F.col("country").isNotNull()).groupBy("pattern_id", "country").agg(F.sum("n").alias("n"))
    return by_country.groupBy("pattern_id").agg(
        F.max(F.struct("n", "country")).getField("country").alias("country"), F.sum("n").alias("programs")
    )


FEATURES = ["log_amount", "months", "level_code", "fee_code", "type_code", "country_code", "log_monthly", "ratio"]
#: What says something of a period, and of a scale (before the scale is applied).
PERIOD_FEATURES = [f for f in FEATURES if f != "months"] + ["iso_code"]
SCALE_FEATURES = ["raw_amount", "months", "level_code", "fee_code", "type_code", "country_code", "log_monthly", "raw_ratio"]


def _code(c: Column, buckets: int = 1 << 20) -> Column:
    """A category as a number; trees split on it. So many numbers that categories hardly ever share one. Missing is -1."""
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(-1.0)).otherwise(F.pmod(F.xxhash64(F.lower(F.trim(c))), F.lit(buckets)).cast("double"))


def _amounts(amount: Column, names: tuple[str, str]) -> dict[str, Column]:
    """The magnitude of an amount, and of its ratio to the given monthly amount."""
    monthly = F.greatest(F.col("monthly_given").cast("double"), F.lit(1e-3))
    low = F.greatest(amount, F.lit(1e-3))
    return {names[0]: F.coalesce(F.log10(low), F.lit(-9.0)), names[1]: F.coalesce(F.log10(low / monthly), F.lit(-9.0))}


def _scaled(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_amounts(F.col("amount").cast("double") * F.col("scale"), ("log_amount", "ratio")))


def _features(rows: DataFrame) -> DataFrame:
    monthly = F.col("monthly_given").cast("double")
    rows = rows.select(
        "*",
        _code(F.col("degree_level")).alias("level_code"),
        _code(F.col("fee_type")).alias("fee_code"),
        _code(F.col("tuition_type")).alias("type_code"),
        _code(F.col("country")).alias("country_code"),
        F.coalesce(F.log10(F.greatest(monthly, F.lit(1e-3))), F.lit(-9.0)).alias("log_monthly"),
    )
    return _scaled(rows.withColumns(_amounts(F.col("amount").cast("double"), ("raw_amount", "raw_ratio"))))


class CurrencyModel:
    """A random forest over the labelled rows, its top probability calibrated by isotonic regression on rows that the
    forest hasn't seen. It predicts currencies, and with another `target` and its `features` periods and scales."""

    def __init__(self, sample_rows: int = 20_000, trees: int = 24, depth: int = 8, seed: int = 7, target: str = "iso", features: list[str] = FEATURES):
        self.sample_rows, self.trees, self.depth, self.seed = sample_rows, trees, depth, seed
        self.target, self.features = target, features
        self.forest = self.calibration = None
        self.labels: list[str] = []

    def fit(self, rows: DataFrame) -> "CurrencyModel":
        """rows: the features and the target. At most `sample_rows` of them, those with the lowest hash of their id, are used: the
        one bound of this operator, and only of its training. The labels are those of the sample."""
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.regression import IsotonicRegression

        kept = [F.coalesce(F.col(f), F.lit(-1)).cast("double").alias(f) for f in self.features]
        some = rows.where(F.col(self.target).isNotNull()).orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(self.sample_rows)
        some = some.select(self.target, F.pmod(F.xxhash64("id"), F.lit(4)).alias("fold"), *kept).persist()
        self.labels = sorted(r[0] for r in some.select(self.target).distinct().collect())
        if not self.labels:
            some.unpersist()
            return self
        label = F.array_position(F.array(*[F.lit(c) for c in self.labels]), F.col(self.target)) - 1
        labelled = some.select(label.cast("double").alias("label"), "fold", *self.features)
        vectors = VectorAssembler(inputCols=self.features, outputCol="features").transform(labelled).select("label", "fold", "features").persist()
        train, held = vectors.where("fold > 0"), vectors.where("fold = 0")
        if train.limit(10).count() < 10 or held.limit(1).count() < 1:
            vectors.unpersist()
            some.unpersist()
            return self
        self.forest = RandomForestClassifier(
            numTrees=self.trees, maxDepth=self.depth, seed=self.seed, maxBins=64, subsamplingRate=0.8
        ).fit(train)
        scored = self.forest.transform(held).select(
            F.array_max(vector_to_array("probability")).alias("top"), (F.col("prediction") == F.col("label")).cast("double").alias("hit")
        )
        self.calibration = IsotonicRegression(featuresCol="top", labelCol="hit").fit(scored)
        vectors.unpersist()
        some.unpersist()
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds predicted_ and the target's name, and its calibrated probability; both null if there was nothing to learn
        from."""
        found = f"predicted_{self.target}"
        if self.forest is None:
            return rows.select("*", F.lit(None).cast("string").alias(found), F.lit(None).cast("double").alias("probability"))
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        names = rows.columns
        x = rows.select("*", *[F.coalesce(F.col(f), F.lit(-1)).cast("double").alias(f"__x_{f}") for f in self.features])
        x = VectorAssembler(inputCols=[f"__x_{f}" for f in self.features], outputCol="__features").transform(x)
        self.forest.setFeaturesCol("__features").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__y")
        x = self.forest.transform(x).withColumn("__top", F.array_max(vector_to_array("__p")))
        self.calibration.setFeaturesCol("__top").setPredictionCol("probability")
        x = self.calibration.transform(x)
        code = F.element_at(F.array(*[F.lit(c) for c in self.labels]), F.col("__y").cast("int") + 1)
        return x.select(*names, code.alias(found), "probability")


def normalise_fees(
    patterns: DataFrame,
    rates: DataFrame,
    sources: DataFrame | None = None,
    confident: float = 0.9,
    model: CurrencyModel | None = None,
) -> DataFrame:
    """Each pattern's monthly amount in its own currency and in US dollars.

    Columns: id, iso_currency, unit_source (stated, predicted, review), period_source (the same of the period alone, null
    where none applies), probability (1 for stated units, else that of all predictions together), scale, months,
    monthly_given (the table's own value), monthly (computed), monthly_usd, off (whether monthly_given is missing or more
    than 1 % off).

    What neither fields nor note state is predicted, each by a forest trained on rows that state it: the scale where
    neither it nor a currency is named (a named currency without scale counts in whole units), the currency (by `model`),
    and the period of an amount that isn't a range or a price per credit or course. Periods are learnt from rows whose
    tuition type doesn't name it, as it doesn't in the rows they are predicted for. A prediction is used from a calibrated
    probability of `confident` on; if one is below, the row gets unit_source review and no amounts, and what isn't known
    of its units is null. Rows whose predicted currency isn't in `rates` get no US-dollar value. Without amount, or for
    ranges and prices per credit or course, monthly and off are null. Amounts of 0 give 0. Repeated ids stay as rows.
    Empty tables give no rows; with no labelled rows nothing is predicted. Other columns aren't read.
    """
    currency, note, kind = F.col("currency"), F.col("normalization_note"), F.col("tuition_type")
    p = patterns.select(
        "id", "amount", "degree_level", "fee_type", "tuition_type", F.col("normalized_monthly_amount").alias("monthly_given"),
        stated_currency(currency, note).alias("stated_iso"),
        stated_scale(currency, note).alias("scale"),
        stated_months(kind, note).alias("months"),
        (F.col("amount").isNotNull() & scale_is_open(currency, note)).alias("scale_open"),
        (F.col("amount").isNotNull() & stated_months(kind, note).isNull() & ~piece_price(kind, note)).alias("period_open"),
        F.coalesce(F.lower(F.trim(kind)).isin(*TYPE_MONTHS), F.lit(False)).alias("typed"),
    )
    if sources is not None:
        p = p.join(sources.select(F.col("pattern_id").alias("id"), "country"), "id", "left")
    else:
        p = p.withColumn("country", F.lit(None).cast("string"))
    space = Workspace(patterns.sparkSession, "fees")
    x = space.write(_features(p), "features")  # read for training and for all kinds of rows
    labelled = x.where("stated_iso IS NOT NULL AND amount IS NOT NULL")

    def learnt(rows: DataFrame, target: str, features: list[str], wanted: DataFrame) -> CurrencyModel:
        m = CurrencyModel(target=target, features=features)
        return m if wanted.isEmpty() else m.fit(rows)

    def apply(rows: DataFrame, m: CurrencyModel, where: str, name: str) -> DataFrame:
        """Adds `name` (what is predicted, null where unsure) and its probability for the rows of `where`."""
        guessed = m.predict(rows.where(where))
        sure = F.coalesce(F.col("probability") >= confident, F.lit(False)) & F.col("amount").isNotNull()
        guessed = guessed.select(*rows.columns, F.when(sure, F.col(f"predicted_{m.target}")).alias(name), F.col("probability").alias(f"{name}_p"))
        other = rows.where(f"NOT ({where})").select("*", F.lit(None).cast("string").alias(name), F.lit(1.0).alias(f"{name}_p"))
        return other.unionByName(guessed)

    scales = labelled.withColumn("scale_text", F.col("scale").cast("string"))
    x = apply(x, learnt(scales, "scale_text", SCALE_FEATURES, x.where("scale_open")), "scale_open", "scale_found")
    x = _scaled(x.withColumn("scale", F.when(F.col("scale_open"), F.col("scale_found").cast("double")).otherwise(F.col("scale"))))
    if model is None:
        model = learnt(labelled.withColumnRenamed("stated_iso", "iso"), "iso", FEATURES, x.where("stated_iso IS NULL"))
    x = apply(x, model, "stated_iso IS NULL", "iso_found")
    x = x.withColumn("iso_currency", F.coalesce("stated_iso", "iso_found")).withColumn("iso_code", _code(F.col("iso_currency")))
    x = space.write(x, "currencies")
    periods = x.where("stated_iso IS NOT NULL AND amount IS NOT NULL AND months IS NOT NULL AND NOT typed").withColumn("months_text", F.col("months").cast("string"))
    x = apply(x, learnt(periods, "months_text", PERIOD_FEATURES, x.where("period_open")), "period_open", "months_found")
    months = F.coalesce("months", F.col("months_found").cast("int"))
    unsure = F.col("iso_currency").isNull() | (F.col("scale_open") & F.col("scale").isNull()) | (F.col("period_open") & F.col("months_found").isNull())
    some = F.col("stated_iso").isNull() | F.col("scale_open") | F.col("period_open")
    x = x.select(
        "id", F.when(F.col("stated_iso").isNotNull() | ~unsure, F.col("iso_currency")).alias("iso_currency"), "amount", "monthly_given", "scale", months.alias("months"),
        F.when(unsure, "review").when(some, "predicted").otherwise("stated").alias("unit_source"),
        F.when(F.col("period_open"), F.when(F.col("months_found").isNull(), "review").otherwise("predicted")).when(F.col("months").isNotNull(), "stated").alias("period_source"),
        (F.col("scale_found_p") * F.col("iso_found_p") * F.col("months_found_p")).alias("probability"),
    )
    monthly = F.when(F.col("unit_source") != "review", F.col("amount").cast("double") * F.col("scale") / F.col("months"))
    given = F.col("monthly_given").cast("double")
    off = given.isNull() | (F.abs(given - F.col("monthly")) > F.lit(0.01) * F.abs(F.col("monthly")))
    rate = rates.select(F.col("currency").alias("iso_currency"), F.col("usd_per_unit"))
    return (
        x.withColumn("monthly", monthly)
        .join(rate, "iso_currency", "left")
        .select(
            "id", "iso_currency", "unit_source", "period_source", "probability", "scale", "months", "monthly_given", "monthly",
            (F.col("monthly") * F.col("usd_per_unit")).alias("monthly_usd"),
            F.when(F.col("monthly").isNotNull(), off).alias("off"),
        )
    )


def wrong_fees(normalised: DataFrame) -> DataFrame:
    """(id, iso_currency) of the rows of `normalise_fees` that state their period and whose own monthly amount is missing
    or off."""
    return normalised.where("off AND period_source = 'stated'").select("id", "iso_currency").distinct()
