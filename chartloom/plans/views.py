"""The given tables seen as the operators' inputs, in Spark and in SQL. The synthetic prose has no clinical words, so what
stands for confidences, sources and codes is derived from numbers that the tables do have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions import letters, text


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def blocks(self) -> DataFrame:
        """Turns of conversations as blocks of OCR pages."""
        kind = F.when(F.col("role") == "system", "TITLE").when(F.col("role") == "user", "LINE").otherwise("WORD")
        return self.table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.floor(F.col("turn") / 4).alias("page"), kind.alias("type"), (60.0 + F.length("text") % 41).alias("conf"), "text")

    def entities(self) -> DataFrame:
        """Lines of orders as entities of documents."""
        source = F.when(F.col("l_linestatus") == "F", "comprehend_medical").otherwise("semantic_fallback")
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") * 10).alias("score"), source.alias("source"), F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("code"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("pos"))

    def components(self) -> DataFrame:
        """Mean values of a user's events by type, as scores in per cent."""
        mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
        return self.table("events").groupBy(F.col("user_id").alias("doc_id")).agg(mean("click").alias("textract"), mean("view").alias("comprehend"), mean("signup").alias("faiss"), mean("purchase").alias("llm_logprobs"))

    def audit(self) -> DataFrame:
        kinds = F.when(F.col("event_type") == "click", "SNOMED_STATUS").when(F.col("event_type") == "view", "SUMMARY_EDIT").otherwise("OTHER")
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(F.col("event_id").cast("string").alias("audit_id"), (F.col("user_id") % 97).alias("document_id"), F.col("user_id").cast("string").alias("user_id"), ts.alias("ts"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), kinds.alias("change_type"), F.lit(None).cast("string").alias("before_state"), F.lit(None).cast("string").alias("after_state"), F.col("props").alias("metadata"))

    def proposals(self) -> DataFrame:
        """Whole documents cut into regions of 60 characters, each with a letter changed as its correction."""
        cut = self.table("documents").select("doc_id", "n_chars", F.posexplode(text.slice_text(F.col("text"), 60)).alias("idx", "s"))
        a, n = F.col("s.part"), F.col("n_chars") + F.col("idx")
        return cut.select("doc_id", "idx", a.alias("a"), F.translate(a, "e", "c").alias("b"), (n % 100 / 100).alias("llm"), (n % 37 / 37).alias("conf"))

    def summaries(self) -> DataFrame:
        """Assistant turns against the user turns of their conversation."""
        said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x.text), " ")
        return self.table("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(said("assistant").alias("candidate"), said("user").alias("source"))

    def dictionary(self) -> DataFrame:
        return self.table("part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("dict_code"), F.col("p_partkey").alias("pos"))

    def vectors(self) -> tuple[DataFrame, DataFrame]:
        """Every fiftieth row as a query against all rows, itself included."""
        e = self.table("embeddings")
        return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding")

    def letters(self) -> DataFrame:
        """Letters about customers: each has the first sign of one letter type, and details made of its row."""
        signs = F.array(*[F.lit(signals[0]) for _, signals in letters.LETTER_RULES])
        given = self.table("customer").join(F.broadcast(self.table("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        key = F.col("c_custkey")
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        title = F.when(key % 3 == 0, "Mr ").when(key % 3 == 1, "Mrs ").otherwise("Miss ")
        dob = F.concat(two(key % 28 + 1), F.lit("/"), two(key % 12 + 1), F.lit("/"), (key % 90 + 1920).cast("string"))
        nhs = F.lpad((key * 7919 % 10_000_000_000).cast("string"), 10, "4")
        lines = [
            F.get(signs, (key % len(letters.LETTER_RULES)).cast("int")), F.concat(F.lit("Patient Name: "), title, F.initcap("c_mktsegment"), F.lit(", Example")),
            F.concat(F.lit("NHS Number: "), nhs), F.when(key % 2 == 0, F.concat(F.lit("DOB: "), dob)).otherwise(F.concat(F.lit("Date of Birth\n"), dob)), F.concat(F.lit("Hospital Number: H"), key.cast("string"), F.lit("00")),
            F.concat(F.lit("GP Practice: Surgery of "), F.col("n_name")), F.concat(F.lit("Diagnosis: condition "), F.lower("c_mktsegment")), F.concat(F.lit("Plan: see again in "), F.col("n_name")),
        ]
        # rows are short and reading them back is long work: a file of them is one task, so they are dealt out
        return given.repartition(4 * self.spark.sparkContext.defaultParallelism).select("c_custkey", F.concat_ws("\n", *lines).alias("text"))

    def stage_results(self) -> dict[str, DataFrame]:
        """Conversations as extracted documents, orders as coded ones, users' events as summaries and as routed documents."""
        kind = lambda key: F.concat(F.lit("type "), (key % 3).cast("string")).alias("document_type")
        line = F.avg(F.when(F.col("type") == "LINE", F.col("conf")))
        read = self.blocks().groupBy("doc_id").agg(line.alias("line_confidence"), (F.max("pos") / 8).alias("latency_seconds")).select(kind(F.col("doc_id")), (F.col("doc_id") % 10 > 0).alias("success"), "latency_seconds", "line_confidence")
        total = F.when(F.col("doc_id") % 50 > 0, F.count("*")).alias("total")
        coded = self.entities().groupBy("doc_id").agg(total, F.count_if(F.col("quantity") > 10).alias("mapped"), F.count_if(F.col("source") == "semantic_fallback").alias("fallback"), F.max("quantity").alias("latency_seconds")).withColumn("document_type", kind(F.col("doc_id")))
        e = self.table("events")
        told = e.select(kind(F.col("user_id")), F.col("event_type").alias("role"), (F.col("value") * 10).alias("latency_ms"), F.when(F.col("event_type") != "click", F.col("value") / 100).alias("confidence_score"))
        sent = e.select(kind(F.col("event_id")), F.when(F.col("value") > 50, "bypass_database").otherwise("human_review").alias("route"), (F.col("value") / 100).alias("final_confidence"), (F.col("user_id") % 100).cast("double").alias("latency_ms"))
        return {"extraction": read, "mapping": coded, "summaries": told, "routing": sent}

    def answers(self) -> DataFrame:
        """Documents as a model's answers: fenced objects with whole texts in them, single quotes, no object, an open one."""
        d, c = self.table("documents"), F.concat
        roles = lambda doctor, pharmacist, reception: F.struct(doctor.alias("doctor"), pharmacist.alias("pharmacist"), reception.alias("reception"))
        none = F.array().cast("array<string>")
        whole = F.to_json(F.struct(roles(F.array("text", "source"), none, F.array("lang")).alias("sender_actions"), roles(F.array(F.lit("")), F.array("lang"), F.array("text")).alias("gp_surgery_actions")))
        single = c(F.lit("{'sender_actions': {'doctor': ['see {"), "lang", F.lit("', '', 'call "), "source", F.lit("']}, 'gp_surgery_actions': 'none'} }"))
        kind = F.col("doc_id") % 4
        raw = F.when(kind == 0, c(F.lit("Sure. ```json\n"), whole, F.lit('\n``` and {"x": [1]} }'))).when(kind == 1, single).when(kind == 2, c(F.lit("no object for "), "source"))
        return d.select("doc_id", raw.otherwise(c(F.lit('{"sender_actions": {"doctor": ["'), "source", F.lit('"'))).alias("raw"))

    def first_of_rows(self, df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


_SIGNS = ", ".join("'" + signals[0].replace("'", "''") + "'" for _, signals in letters.LETTER_RULES)
LETTERS = f"""parts AS (SELECT c_custkey, c_mktsegment, n_name, [{_SIGNS}] AS signs, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment,
    CASE c_custkey % 3 WHEN 0 THEN 'Mr ' WHEN 1 THEN 'Mrs ' ELSE 'Miss ' END AS title,
    lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '/' || (c_custkey % 90 + 1920) AS dob,
    lpad((c_custkey::BIGINT * 7919 % 10000000000)::VARCHAR, 10, '4') AS nhs, 'H' || c_custkey || '00' AS hospital_number FROM customer JOIN nation ON c_nationkey = n_nationkey),
letters AS (SELECT *, segment || ', Example' AS name, signs[c_custkey % len(signs) + 1] || chr(10) || 'Patient Name: ' || title || segment || ', Example' || chr(10) || 'NHS Number: ' || nhs || chr(10) ||
    'DOB: ' || dob || chr(10) || 'Hospital Number: ' || hospital_number || chr(10) || 'GP Practice: Surgery of ' || n_name || chr(10) || 'Diagnosis: condition ' || lower(c_mktsegment) || chr(10) || 'Plan: see again in ' || n_name AS text FROM parts)"""
BLOCKS = """blocks AS (SELECT conv_id AS doc_id, turn AS pos, turn // 4 AS page,
    CASE role WHEN 'system' THEN 'TITLE' WHEN 'user' THEN 'LINE' ELSE 'WORD' END AS type, 60.0::DOUBLE + length(text) % 41 AS conf, text FROM conversations)"""
ENTITIES = """entities AS (SELECT l_orderkey AS doc_id, l_discount * 10 AS score,
    CASE l_linestatus WHEN 'F' THEN 'comprehend_medical' ELSE 'semantic_fallback' END AS source, l_returnflag AS category, l_partkey AS code, l_quantity AS quantity, l_suppkey AS supp, l_linenumber AS pos FROM lineitem)"""
COMPONENTS = """components AS (SELECT user_id AS doc_id, avg(value) FILTER (event_type = 'click') AS textract, avg(value) FILTER (event_type = 'view') AS comprehend,
    avg(value) FILTER (event_type = 'signup') AS faiss, avg(value) FILTER (event_type = 'purchase') AS llm_logprobs FROM events GROUP BY 1)"""
AUDIT = """audit AS (SELECT event_id::VARCHAR AS audit_id, user_id % 97 AS document_id, user_id::VARCHAR AS user_id, ts,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE event_type WHEN 'click' THEN 'SNOMED_STATUS' WHEN 'view' THEN 'SUMMARY_EDIT' ELSE 'OTHER' END AS change_type, props AS metadata FROM events)"""
PROPOSALS = """cuts AS (SELECT doc_id, n_chars, text, unnest(range(0, (length(text) + 59) // 60)) AS idx FROM documents),
    proposals AS (SELECT doc_id, idx, substring(text, idx * 60 + 1, 60) AS a, translate(substring(text, idx * 60 + 1, 60), 'e', 'c') AS b, ((n_chars + idx) % 100) / 100.0::DOUBLE AS llm, ((n_chars + idx) % 37) / 37.0::DOUBLE AS conf FROM cuts)"""
SUMMARIES = """summaries AS (SELECT conv_id AS doc_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS candidate,
    coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS source FROM conversations GROUP BY 1)"""
STAGE_RESULTS = f"""{BLOCKS}, {ENTITIES},
    read AS (SELECT 'type ' || (doc_id % 3) AS document_type, doc_id % 10 > 0 AS ok, max(pos) / 8 AS seconds, coalesce(avg(conf) FILTER (type = 'LINE'), 0.0) AS conf FROM blocks GROUP BY doc_id),
    coded AS (SELECT 'type ' || (doc_id % 3) AS document_type, CASE WHEN doc_id % 50 > 0 THEN count(*) END AS total, count(*) FILTER (quantity > 10) AS mapped, count(*) FILTER (source = 'semantic_fallback') AS fallback, max(quantity) AS seconds FROM entities GROUP BY doc_id),
    points AS (
    SELECT unnest([{{'metric': 'StageLatencySeconds', 'unit': 'Seconds', 'value': seconds}}, {{'metric': 'ExtractionSuccessCount', 'unit': 'Count', 'value': ok::INT::DOUBLE}}, {{'metric': 'ExtractionErrorRate', 'unit': 'Percent', 'value': CASE WHEN ok THEN 0.0 ELSE 100.0 END}},
        {{'metric': 'ExtractionConfidenceAvg', 'unit': 'Percent', 'value': CASE WHEN ok THEN conf END}}, {{'metric': 'ExtractionErrorRate', 'unit': 'Percent', 'value': CASE WHEN ok THEN greatest(0.0, least(100.0, 100 - conf)) END}}]) AS m, 'Tier1Textract' AS stage, document_type, NULL::VARCHAR AS role, NULL::VARCHAR AS route FROM read
    UNION ALL SELECT unnest([{{'metric': 'StageLatencySeconds', 'unit': 'Seconds', 'value': CASE WHEN total IS NOT NULL THEN seconds::DOUBLE END}}, {{'metric': 'SNOMEDMappingSuccessRate', 'unit': 'Percent', 'value': CASE WHEN total > 0 THEN mapped / total * 100 ELSE 0.0 END}},
        {{'metric': 'SNOMEDFallbackCount', 'unit': 'Count', 'value': CASE WHEN total IS NOT NULL THEN fallback::DOUBLE END}}]), 'TrackASNOMED', document_type, NULL, NULL FROM coded
    UNION ALL SELECT unnest([{{'metric': 'LLMInferenceLatencyMs', 'unit': 'Milliseconds', 'value': value * 10}}, {{'metric': 'LLMConfidenceScore', 'unit': 'None', 'value': CASE WHEN event_type <> 'click' THEN value / 100 END}}]), 'TrackBSummarization', 'type ' || (user_id % 3), event_type, NULL FROM events
    UNION ALL SELECT unnest([{{'metric': 'UnifiedConfidenceScore', 'unit': 'None', 'value': value / 100}}, {{'metric': 'AggregationLatencyMs', 'unit': 'Milliseconds', 'value': (user_id % 100)::DOUBLE}}]), 'ConfidenceAggregation', 'type ' || (event_id % 3), NULL, CASE WHEN value > 50 THEN 'bypass_database' ELSE 'human_review' END FROM events)"""
#: Letters and digits beyond ASCII as underscores: word boundaries of an ASCII-only engine then stand where Unicode has them.
WORDLY = "regexp_replace(regexp_replace({0}, '[^\\P{{L}}\\x00-\\x7F]', '_', 'g'), '[^\\P{{Nd}}\\x00-\\x7F]', '_', 'g')"
UNIT = "CASE WHEN {0} IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN {0} > 1 THEN {0} / 100 ELSE {0} END)) END"
