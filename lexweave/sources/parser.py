"""A pluggable connector to a parser service: posts go out sentence by sentence, parser blocks come back as text columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as X

#: The blocks of an answer: the lattice of all analyses, the chosen one, and the tree.
BLOCKS = ("ma_lattice", "md_lattice", "dep_tree")


def http_client(url: str, timeout: float = 60.0) -> Callable[[], Callable[[str], dict]]:
    """A connection maker for a service that takes ``{"text": ...}`` by POST and answers with a JSON object of blocks."""

    def connect() -> Callable[[str], dict]:
        def ask(text: str) -> dict:
            body = json.dumps({"text": f"  {text}  "}, ensure_ascii=False).encode()
            request = Request(url, body, {"Content-Type": "application/json; charset=utf-8"})
            with urlopen(request, timeout=timeout) as answer:
                return json.load(answer)

        return ask

    return connect


def parsed(posts: DataFrame, connect: Callable[[], Callable[[str], dict]], key: str = "post_id", text: str = "tokenized_text") -> DataFrame:
    """``key, sentence_no, sentence`` and a text column for each of ``BLOCKS``; null texts are not sent, missing blocks are null.

    ``connect`` is called once in each task. An error of the service fails the task, which is then tried again.
    """
    cleaned = X.squeezed_spaces(X.parser_input(F.col(text)))
    sentences = posts.where(F.col(text).isNotNull()).select(key, F.posexplode(X.sentences(cleaned)).alias("sentence_no", "sentence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()
        for batch in batches:
            answers = [ask(s) for s in batch["sentence"]]
            yield batch.assign(**{b: [a.get(b) for a in answers] for b in BLOCKS})

    kind = dict(posts.dtypes)[key]
    return sentences.mapInPandas(run, f"{key} {kind}, sentence_no int, sentence string, " + ", ".join(f"{b} string" for b in BLOCKS))
