"""Language and embedding models behind one interface, with deterministic offline stubs.

A provider is any object with the methods of ``StubProvider``; it must be picklable. Each operator maps rows in Arrow batches;
a row that fails gets its message in ``error`` and does not stop the others.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_ITEMS = "array<struct<question:string,answer:string,type:string,city:string,source_msg_id:string>>"
BRANCHES = "array<struct<topic:string,message_ids:array<bigint>>>"
JUDGED = "array<struct<index:int,faithful:boolean,atomic:boolean,useful:boolean,type_suggested:string,city_suggested:string,note:string>>"
ANSWER_JUDGED = "faithful boolean, faithful_note string, relevant boolean, relevant_note string, scope_ok boolean, scope_note string, honest_uncertainty boolean, honest_uncertainty_note string"


class StubProvider:
    """Answers by rule, for tests and for runs without a network."""

    def __init__(self, width: int = 64):
        self.width = width

    def chat_json(self, task: str, text: str) -> str:
        lines = [x for x in text.split("\n") if x.strip()]
        n = int(hashlib.sha256(text.encode()).hexdigest(), 16)
        if task == "branches":
            return json.dumps({"branches": [{"topic": "all", "message_ids": [int(x[1 : x.index("]")]) for x in lines if x.startswith("[") and "]" in x and x[1 : x.index("]")].isdigit()]}]})
        if task == "distill":
            return json.dumps({"items": [{"question": lines[0], "answer": lines[-1], "type": "vote_based", "city": None, "source_msg_id": None}] if len(lines) > 1 else []})
        if task == "judge":  # by the length of each unit's block; type and city as they are, but for every ninth length
            results = []
            for k, block in enumerate(re.split(r"\n\n(?=\[\d+\] )", text.split("ПАРЫ:\n", 1)[-1])):
                m, named = len(block), re.search(r"\nТип: (.*)\nГород: (.*)$", block)
                results.append({"index": k, "faithful": m % 5 != 0, "atomic": m % 3 != 0, "useful": m % 7 != 0, "type_suggested": "date_based" if m % 9 == 0 else named and named[1], "city_suggested": named and named[2], "note": ""})
            return json.dumps({"results": results})
        if task == "judge_answer":
            return json.dumps({"faithful": len(text) % 5 != 0, "relevant": len(text) % 7 != 0, "scope_ok": True, "honest_uncertainty": len(text) % 2 == 0, "faithful_note": " n "})
        if task == "merge":  # the first question and the last answer
            found = re.findall(r"^Вопрос: (.*)\nОтвет: (.*)$", text, re.M)
            return json.dumps({"question": found[0][0], "answer": found[-1][1]} if found else {})
        if task == "reverify":
            return json.dumps({"faithful": n % 2 == 0, "note": ""})
        if task == "recall":
            return json.dumps({"has_knowledge": len(lines) > 3, "missed": ""})
        if task == "atomize":
            return json.dumps({"items": [{"question": x, "answer": x, "type": None, "city": None, "source_msg_id": None} for x in lines]})
        if task == "relevance":
            return json.dumps({"results": [{"index": k, "relevant": (n >> k) % 2 == 0, "note": ""} for k in range(len(lines))]})
        if task == "rewrite":
            return json.dumps({"query": lines[-1] if lines else ""})
        if task == "classify":
            return json.dumps({"label": "request" if text.rstrip().endswith("?") else "other", "query": text.strip()})
        return json.dumps({"text": lines[0] if lines else ""})

    def embed(self, texts: list[str]) -> np.ndarray:
        """Signed hashing of words, one row a text."""
        out = np.zeros((len(texts), self.width), np.float32)
        for k, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest(), 16)
                out[k, h % self.width] += 1 if (h >> 64) % 2 else -1
        return out


def ask(rows: DataFrame, provider, task: str, text: str, schema: str, out: str = "reply") -> DataFrame:
    """Add ``out`` (the parsed answer; what can't be parsed is null) and ``error``. Columns are kept."""
    names = list(rows.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            replies, errors = [], []
            for t in df[text]:
                try:
                    replies.append(provider.chat_json(task, t or ""))
                    errors.append(None)
                except Exception as e:  # a failed call is data here: the row keeps its message
                    replies.append(None)
                    errors.append(str(e)[:500])
            yield df[names].assign(_reply=pd.Series(replies, index=df.index, dtype=object), error=pd.Series(errors, index=df.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, _reply string, error string").withColumn(out, F.from_json("_reply", schema)).drop("_reply")


def embed(rows: DataFrame, provider, text: str, batch: int = 100) -> DataFrame:
    """Add ``embedding``, ``batch`` texts a call."""
    names = list(rows.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            vectors = [v.tolist() for k in range(0, len(df), batch) for v in provider.embed(list(df[text].iloc[k : k + batch]))]
            yield df[names].assign(embedding=vectors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, embedding array<float>")
