"""Conversation state and the offline router, for tables of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X


def conversation_window(messages: DataFrame, conversation: str, order: list[str], turns: int = 12) -> DataFrame:
    """The last 2 * turns messages of each conversation; only partial winners are shuffled."""
    w = W.partitionBy(conversation).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * turns).drop("_r")


_ROUTE = T.StructType([T.StructField("route", T.StringType()), T.StructField("argument", T.StringType()), T.StructField("answer", T.StringType())])


@F.pandas_udf(_ROUTE)
def route(text: pd.Series, is_question: pd.Series, lang: pd.Series) -> pd.DataFrame:
    """calculator for arithmetic, search for questions and look-up words, else an echo. Null text gives null."""
    from ..functions.calculator import arithmetic_in, calculate
    from ..functions.words import ECHO, SEARCH_WORDS

    rows = []
    for t, q, code in zip(text, is_question, lang):
        if t is None:
            rows.append((None, None, None))
        elif e := arithmetic_in(t):
            rows.append(("calculator", e, calculate(e)))
        elif q or any(w in t.lower() for w in SEARCH_WORDS):
            rows.append(("search_knowledge_base", t, None))
        else:
            rows.append(("echo", None, ECHO.get(code, ECHO["en"]).format(text=t)))
    return pd.DataFrame(rows, columns=["route", "argument", "answer"])


def routed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, route, argument, answer) of every question."""
    t = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), route(t, F.coalesce(X.looks_like_question(t), F.lit(False)), X.language(t)).alias("r")).select("id", "r.*")


def prompts(turns: DataFrame, messages: DataFrame, system: str, window: int = 12) -> DataFrame:
    """turns (conversation, turn_id, question, context), messages (conversation, seq, role, content) -> (turn_id, prompt): the instructions,
    the last ``window`` turns of the conversation in order, and the question with what was found for it."""
    last = conversation_window(messages, "conversation", ["seq"], window)
    said = last.groupBy("conversation").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("said"))
    part = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "question")).otherwise(F.col("question"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return turns.join(said, "conversation", "left").select("turn_id", F.concat(F.array(part("system", F.lit(system))), F.coalesce("said", none), F.array(part("user", asked))).alias("prompt"))


def remember(memory: DataFrame | None, texts: DataFrame, embedder_dim: int = 384) -> DataFrame:
    """The memory (id, text, embedding) with texts (id, text) added; a text of an id remembered before is left out."""
    from .retrieval import hashing_embeddings

    new = texts.where("id is not null and text is not null").dropDuplicates(["id"])
    if memory is not None:
        new = new.join(memory.select("id"), "id", "left_anti")
    new = new.join(hashing_embeddings(new, "id", "text", embedder_dim), "id").select("id", "text", "embedding")
    return new if memory is None else memory.select("id", "text", "embedding").unionByName(new)


def recall(memory: DataFrame, questions: DataFrame, k: int = 3, embedder_dim: int = 384) -> DataFrame:
    """questions (query_id, query_text) -> (query_id, rank, id, text): the k texts of the memory most similar to each."""
    from .retrieval import hashing_embeddings
    from .vectors import knn_exact

    asked = hashing_embeddings(questions, "query_id", "query_text", embedder_dim)
    found = knn_exact(memory.select("id", "embedding"), asked, k, embedder_dim, skip_self=False)
    return found.join(memory.select("id", "text"), "id").select("query_id", "rank", "id", "text")


def reply_for(lang, replies: dict[str, str]):
    """Canned reply in the language, English where there is none."""
    m = F.create_map(*[F.lit(x) for kv in replies.items() for x in kv])
    return F.coalesce(F.try_element_at(m, lang), F.lit(replies["en"]))


def react(turns: DataFrame, model, tools: dict, max_steps: int = 6) -> DataFrame:
    """turns (turn_id, question) -> (turn_id, answer, steps): think, call a tool, observe, at most ``max_steps`` times.

    ``model(messages) -> completion`` and ``tools[name](**arguments) -> text`` are any functions a worker can import. A tool's error
    is its observation; a call made before with the same arguments in a turn isn't made again.
    """
    def one(question: str) -> tuple[str, int]:
        import json

        from ..functions.calculator import parse_step

        messages, seen = [("user", question)], {}
        for step in range(1, max_steps + 1):
            s = parse_step(model(messages))
            if s["final_answer"] is not None:
                return s["final_answer"], step
            call = (s["action"], s["action_input"])
            if call not in seen:
                try:
                    seen[call] = str(tools[s["action"]](**json.loads(s["action_input"])))
                except KeyError:
                    seen[call] = f"Error: unknown tool {s['action']!r}"
                except Exception as e:
                    seen[call] = f"Error: {e}"
            messages += [("assistant", f"Action: {call[0]}\nAction Input: {call[1]}"), ("user", f"Observation: {seen[call]}")]
        return parse_step(model([*messages, ("user", "Give the final answer now.")]))["final_answer"] or "", max_steps + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [one(q or "") for q in p["question"]]
            yield pd.DataFrame({"turn_id": p["turn_id"], "answer": [a for a, _ in got], "steps": [n for _, n in got]})

    return turns.select(F.col("turn_id").cast("bigint").alias("turn_id"), "question").mapInPandas(run, "turn_id bigint, answer string, steps int")


def latest_revision(log: DataFrame) -> DataFrame:
    """log (run_id, revision, ...): the row of the highest revision of each run; a revision written twice counts once."""
    w = W.partitionBy("run_id").orderBy(F.desc("revision"))
    return log.dropDuplicates(["run_id", "revision"]).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def argument_errors(schema: dict):
    """A column function (JSON text) -> null if the arguments fit the tool's JSON schema, else what is wrong; a boolean is no integer."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}

    @F.pandas_udf(T.StringType())
    def check(raw: pd.Series) -> pd.Series:
        import json

        def one(text):
            try:
                given = json.loads(text or "{}")
            except ValueError:
                return "not JSON"
            if not isinstance(given, dict):
                return "not an object"
            for name in schema.get("required", []):
                if name not in given:
                    return f"missing argument {name!r}"
            for name, value in given.items():
                kind = schema.get("properties", {}).get(name, {}).get("type")
                if kind and (not isinstance(value, kinds[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
                    return f"argument {name!r} must be {kind}"
            return None

        return raw.map(one)

    return check


def checked_append(log: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (run_id, revision, ...) that follow the last revision of their run; others would overwrite someone's work."""
    last = log.groupBy("run_id").agg(F.max("revision").alias("_last"))
    return new.join(last, "run_id", "left").where(F.col("revision") == F.coalesce("_last", F.lit(0)) + 1).drop("_last")
