"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import bpe, chat_format, decontaminate, language_id, license_scan, near_dedup, packing, period_runs, prefix_trie, quality_classifier, quality_rules, suffix_tree, url_filter
from fieldloom.llm.common import documents, held_out, read_table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its quality."""
    docs = documents(spark, folder).select("doc_id", "text")
    field = quality_classifier.train(docs, read_table(spark, folder, "labels"))
    scored = quality_classifier.score_lines(docs, field, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "score", "n_lines")
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")


def list_history(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts and sections that ``pages`` name, by hash of the name.

    Half of the registered domains were on ``block`` for a while or still are, some came back; a fifth of the hosts was on
    ``adult``; some first path segments were on ``allow``. The days lie in 2024.
    """
    urls = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.element_at(F.split(url_filter.path_of(F.col("url")), "/"), 1).alias("section")).where("host <> ''")
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    day = lambda n: (F.lit(19_723) + n) * 86_400  # noqa: E731  19,723: the days before 2024
    step = lambda n, action: F.struct(F.lit(action).alias("action"), day(n).alias("at"))
    d = F.crc32(F.col("pattern").cast("binary"))
    on, off, back = d % 200, d % 200 + 20 + d % 90, d % 200 + 120 + d % 60
    blocks = urls.select(domain.alias("pattern")).distinct().where(d % 2 == 0).select(
        F.lit("block").alias("list"), F.lit("domain").alias("kind"), "pattern",
        F.when(d % 3 == 0, F.array(step(on, "add"))).when(d % 3 == 1, F.array(step(on, "add"), step(off, "remove"))).otherwise(F.array(step(on, "add"), step(off, "remove"), step(back, "add"))).alias("steps"))
    adult = urls.select(F.col("host").alias("pattern")).distinct().where(d % 5 == 1).select(F.lit("adult").alias("list"), F.lit("domain").alias("kind"), "pattern", F.array(step(on, "add"), step(off, "remove")).alias("steps"))
    sections = urls.select(F.concat("host", F.lit("/"), "section").alias("pattern")).distinct().where(d % 7 == 2).select(
        F.lit("allow").alias("list"), F.lit("prefix").alias("kind"), "pattern", F.array(step(d % 100, "add")).alias("steps"))
    every = blocks.unionByName(adult).unionByName(sections)
    return every.select("list", "kind", "pattern", F.explode("steps").alias("s")).select("list", "kind", "pattern", "s.action", "s.at")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, as fetched in a second of 2024 drawn from its URL, with the list entry that decides on it."""
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    fetched = (F.lit(19_723) * 86_400 + F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % (366 * 86_400)).alias("fetched_at")
    judged = url_filter.evaluate(pages.select("page_id", "url", fetched), list_history(pages))
    return judged.select("row.page_id", "row.url", "row.fetched_at", "host", "n_active", F.col("list").alias("list_name"), "pattern", "blocked")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one with control strings in its texts, formatted and read back."""
    hard = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat_format.read_back(chat_format.format_conversations(turns))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how much of it."""
    return decontaminate.contaminated(documents(spark, folder), read_table(spark, folder, "benchmark"))


def op5_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its log probability by word frequencies and by the suffix tree."""
    docs = documents(spark, folder).select("doc_id", "text", (~held_out("doc_id", 10, 0)).alias("learn"))
    scored = suffix_tree.score_texts(docs)
    return scored.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_states")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    pieces = packing.tokenised(documents(spark, folder), vocabulary(), end_id=1)
    return packing.pack(pieces, {"ids_crc32": F.crc32("ids")}).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its language."""
    docs = documents(spark, folder)
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its license phrases and notices."""
    scanned = license_scan.scan(documents(spark, folder).select("doc_id", "text"), carry=["doc_id"])
    return scanned.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return near_dedup.near_duplicate_classes(documents(spark, folder)).select("doc_id", "class_id", "class_size", "representative")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its statistics and the verdict of the line rules."""
    narrow = documents(spark, folder).select("doc_id", "source", "text")
    return quality_rules.judge(narrow).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed_lines"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h, the crc32 of the id, is divisible by 10, the text's end repeats its words with a period.

    With n words and g = h / 10, each word i from a = g mod n on is word a + (i - a) mod p, p = 1 + (n - a) / (3 + g mod 8).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    plain = rows.where("h % 10 <> 0").select("doc_id", "text")
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    listed = rows.where("h % 10 = 0").select("doc_id", "g", split.alias("words")).withColumn("n", F.size("words").cast("bigint"))
    placed = listed.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return plain.unionByName(placed.select("doc_id", F.array_join(changed, " ").alias("text")))


def op11_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, some made periodic at the end, with its runs of repeated words and what is left without them."""
    found = period_runs.collapse_runs(with_periods(documents(spark, folder)), carry=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def shared_starts(conversations: DataFrame) -> DataFrame:
    """Conversations rebuilt to share their starts, as (conv_id, turn, role, text) with turns numbered from 1.

    Conversation c begins with the first h turns of c - c % 20 (h is crc32 of its id mod 4), then come its own turns after
    its first h. A null id begins with none and keeps its turns.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.select("conv_id", F.row_number().over(order).alias("turn"), "role", "text")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    own = placed.where(F.col("conv_id").isNull() | (F.col("turn") > h))
    takers = rows.select("conv_id").dropna().distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h"))
    starts = placed.where((F.col("turn") <= 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed("conv_id", "base")
    shared = starts.join(takers, "base").where(F.col("turn") <= F.col("h")).select("conv_id", "turn", "role", "text")
    return shared.unionByName(own)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the tree of all conversations, rebuilt to share their starts."""
    conversations = read_table(spark, folder, "conversations")
    tree = prefix_trie.prefix_trie(shared_starts(conversations), conversations)
    return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded, as digests of its ids and of the text that they stand for."""
    path = vocabulary("word_bpe_49k.json")
    ids = bpe.encoded(documents(spark, folder), path, carry=["doc_id"]).select("row.doc_id", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))
    text = bpe.decoded(ids, path, carry=["doc_id", "n_tokens", "ids_sha256"])
    return text.select("row.doc_id", "row.n_tokens", "row.ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_url_filter": op2_url_filter,
    "op3_chat_format": op3_chat_format,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_period_runs": op11_period_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_byte_pairs": op13_byte_pairs,
}
