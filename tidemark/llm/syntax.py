"""Source files that are not valid in the language of their extension."""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread
from .grammars import grammar
from .lexers import java_tokens, json_tokens, py_tokens, sql_bodies, sql_tokens, ts_tokens, xml_tokens, yaml_tokens

LANGUAGE_OF = {"java": "java", "ts": "ts", "sql": "sql", "py": "py", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml"}
_TOKENS = {"java": java_tokens, "sql": sql_tokens, "py": py_tokens, "json": json_tokens, "yaml": yaml_tokens, "xml": xml_tokens}


def _confirmed(lang: str, text: str) -> bool:
    """Whether the language's own parser refuses a text, where Python has one; run only on texts that the grammar refused."""
    try:
        if lang == "json":
            json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        elif lang == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif lang == "xml":
            expat.ParserCreate().Parse(text.encode("utf-8", "surrogatepass"), True)
        else:
            return True
        return False
    except (ValueError, SyntaxError, expat.ExpatError, RecursionError, MemoryError):
        return True


def failure(lang: str, text: str) -> tuple[str, int] | None:
    """None for a valid text, else the kind (``token`` or ``end``) and place of its failure."""
    if lang == "ts":
        tokens = list(ts_tokens(text))

        def line_before(i: int) -> bool:  # where a statement may end without a semicolon
            return tokens[i][0] == "}" or i > 0 and "\n" in text[tokens[i - 1][1] : tokens[i][1]]

        found = grammar("ts").failure(tokens, ";", line_before)
    else:
        found = grammar(lang).failure(_TOKENS[lang](text))
        if found is None and lang == "sql" and re.search(r"(?i)language\s+'?plpgsql", text):
            for body, at in sql_bodies(text):
                inner = grammar("plpgsql").failure(sql_tokens(body))
                if inner:
                    return inner[0], at + max(inner[1], 0)
    if found is not None and not _confirmed(lang, text):
        return None
    return found


def check_files(files: DataFrame) -> DataFrame:
    """(file_id, repository, language, valid, failure, place) of the files with a checked extension.

    ``failure`` is ``token`` where the derivative by a token is empty, at ``place`` in code
    points, and ``end`` where the text is cut off. Each file is read whole, without a shuffle.
    Null contents and other extensions are not judged; empty texts are valid where the grammar
    derives the empty text. Repeated rows are judged each.
    """
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fid, repo, lang, text in zip(pdf["file_id"].tolist(), pdf["repository"], pdf["language"], pdf["file_content"]):
                bad = failure(lang, text)
                out.append((fid, repo, lang, bad is None, bad and bad[0], bad and bad[1]))
            yield pd.DataFrame({k: pd.Series(v, dtype=t) for (k, t), v in zip((("file_id", "int64"), ("repository", object), ("language", object), ("valid", bool), ("failure", object), ("place", "Int64")), zip(*out) if out else [[]] * 6)})

    lang = F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGE_OF.items() for x in kv)), ext)
    held = files.where("file_id is not null and file_path is not null and file_content is not null").select("file_id", "repository", lang.alias("language"), "file_content").where("language is not null")
    return spread(held).mapInPandas(run, "file_id bigint, repository string, language string, valid boolean, failure string, place bigint")


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repository, language, files, invalid, cut_off, rate); null repositories form one group."""
    return check_files(files).groupBy("repository", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("failure") == "end").alias("cut_off")
    ).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 4))
