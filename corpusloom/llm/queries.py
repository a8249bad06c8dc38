"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.sources.tables import table


def p1_found(spark, folder):
    from corpusloom.llm.sourcefiles import not_hand_written

    return not_hand_written(table(spark, folder, "source_files"), table(spark, folder, "ingested_files"), table(spark, folder, "repositories"))


def p2_found(spark, folder):
    from corpusloom.llm.sourcefiles import unparsable

    return unparsable(table(spark, folder, "source_files"))


def p2_rates(spark, folder):
    from corpusloom.llm.sourcefiles import parse_rates

    return parse_rates(table(spark, folder, "source_files"), table(spark, folder, "ingestion_runs"), table(spark, folder, "repositories"))


def p3_found(spark, folder):
    from corpusloom.llm.secrets import credentials

    c = credentials(table(spark, folder, "chunks"), table(spark, folder, "source_files"))
    return c.select("field_name", "item_id", F.explode("lines").alias("line_no"))


def p3_redacted(spark, folder):
    from corpusloom.llm.secrets import credentials

    return credentials(table(spark, folder, "chunks"), table(spark, folder, "source_files"), with_text=True).select("field_name", "item_id", F.size("lines").alias("n_lines"), "redacted")


def p4_found(spark, folder):
    from corpusloom.llm.split import all_pieces

    p = all_pieces(table(spark, folder, "chunks"), table(spark, folder, "source_files"))
    return p.select("item_kind", "item_id").distinct()


def p4_pieces(spark, folder):
    from corpusloom.llm.split import all_pieces

    return all_pieces(table(spark, folder, "chunks"), table(spark, folder, "source_files"))


def p5_found(spark, folder):
    from corpusloom.llm.pii import personal_data

    p = personal_data(table(spark, folder, "incidents"), table(spark, folder, "interactions"))
    return p.select("tab", "row_id", "field_name", F.explode("kinds").alias("kind"))


def p5_masked(spark, folder):
    from corpusloom.llm.pii import personal_data

    return personal_data(table(spark, folder, "incidents"), table(spark, folder, "interactions"), with_text=True).drop("kinds")


def p7_found(spark, folder):
    from corpusloom.llm.alike import alike_pairs

    return alike_pairs(table(spark, folder, "chunks"))


def p7_groups(spark, folder):
    from corpusloom.llm.alike import alike_groups

    return alike_groups(table(spark, folder, "chunks"))


def p8_ids(spark, folder):
    from corpusloom.llm.tokenizer import encode

    return encode(table(spark, folder, "documents"))


def p8_round_trip(spark, folder):
    from corpusloom.llm.tokenizer import round_trip

    return round_trip(table(spark, folder, "documents"))


def p9_found(spark, folder):
    from corpusloom.llm.leaks import leaked

    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_report(spark, folder):
    from corpusloom.llm.leaks import leak_report

    return leak_report(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark, folder):
    from corpusloom.llm.truncation import truncated

    return truncated(table(spark, folder, "documents"))


def p10_rates(spark, folder):
    from corpusloom.llm.truncation import truncation_rates

    return truncation_rates(table(spark, folder, "documents"))


def _sql() -> dict[str, str]:
    from corpusloom.llm import leaks, split

    return {"p4_found": split.FOUND_SQL, "p9_found": leaks.FOUND_SQL, "p9_report": leaks.REPORT_SQL}


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] == "p" and k[1:2].isdigit()}
SQL = _sql()
