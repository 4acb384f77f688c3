"""Translation: cache lookups as joins, one call for each distinct text, output guards and reports."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import quality
from quire.functions.text import IMAGE_PROMPT, digest, prompt, scrub, token_budget

#: Attempts, seconds between them, seconds after each call.
ATTEMPTS, RETRY_PAUSE, CALL_PAUSE = 3, 2.0, 0.3


class Provider(Protocol):
    """What answers prompts. It is pickled to the executors, so it opens its client on first use there."""

    name: str

    def ensure_ready(self) -> None:
        """Raises if the model cannot answer."""

    def translate(self, prompts: list[str], texts: list[str], budgets: list[int]) -> list[str]: ...

    def read_image(self, content: bytes, prompt: str) -> str:
        """The translation of an image's text, empty if it has none."""


class Stub:
    """Deterministic replies for tests: words reversed in order, or whatever a function of the text makes."""

    name = "stub"

    def __init__(self, reply=None, seen=None) -> None:
        self.reply = reply or (lambda text: " ".join(reversed(text.split())))
        self.seen = seen or (lambda content: f"{len(content)} bytes")

    def ensure_ready(self) -> None:
        pass

    def translate(self, prompts: list[str], texts: list[str], budgets: list[int]) -> list[str]:
        return [self.reply(t) for t in texts]

    def read_image(self, content: bytes, prompt: str) -> str:
        return self.seen(content)


class HttpChat:
    """A chat endpoint that takes and returns JSON with ``messages`` and ``options``; the timeout holds for a call."""

    def __init__(self, url: str, model: str, timeout: float = 180.0) -> None:
        self.url, self.name, self.timeout = url, model, timeout

    def ensure_ready(self) -> None:
        """The model's exact name must be in the list that the server gives beside the chat address, under ``tags``."""
        import json
        from urllib.request import urlopen

        with urlopen(f"{self.url.rsplit('/', 1)[0]}/tags", timeout=self.timeout) as answer:
            names = {m["name"] for m in json.load(answer)["models"]}
        if self.name not in names:
            raise LookupError(f"{self.name} is not among {sorted(names)}")

    def _chat(self, message: dict, options: dict) -> str:
        import json
        from urllib.request import Request, urlopen

        body = json.dumps({"model": self.name, "stream": False, "messages": [message], "options": options}).encode()
        with urlopen(Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
            return json.load(answer)["message"]["content"]

    def translate(self, prompts: list[str], texts: list[str], budgets: list[int]) -> list[str]:
        # Sampling options that the model was tuned on.
        return [self._chat({"role": "user", "content": p}, {"repeat_penalty": 1.3, "repeat_last_n": 128, "num_predict": n}) for p, n in zip(prompts, budgets, strict=True)]

    def read_image(self, content: bytes, prompt: str) -> str:
        from base64 import b64encode

        # Sampling options of image calls.
        return self._chat({"role": "user", "content": prompt, "images": [b64encode(content).decode()]}, {"temperature": 0.1, "num_predict": 1024}).strip()


def image_reader(provider: Provider, names: tuple[str, str]):
    """What images.translate_images calls: the provider's reading of an image, asked for in the two languages' names."""
    question = IMAGE_PROMPT % names
    return lambda content: provider.read_image(content, question)


def cache_key(text: Column, *parts: str) -> Column:
    """A digest of the text, model, languages and prompt version; digest(text) alone is the plain key."""
    return F.sha2(F.concat_ws("\x1f", *(F.lit(p) for p in parts), text), 256)


def _calls(provider: Provider, attempts: int, retry_pause: float, call_pause: float):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, tries, errors = [], [], []
            for row in batch.itertuples(index=False):
                reply, error = None, None
                for n in range(1, attempts + 1):
                    try:
                        reply, error = provider.translate([row.prompt], [row.text], [row.budget])[0], None
                        break
                    except Exception as e:  # a provider may fail in any way; the row keeps the reason
                        error = str(e)[:500]
                        if n < attempts:
                            time.sleep(retry_pause)
                replies.append(reply)
                tries.append(n)
                errors.append(error)
                if call_pause:
                    time.sleep(call_pause)
            yield pd.DataFrame({"chunk_hash": batch["chunk_hash"], "text": batch["text"], "raw": replies, "attempts": tries, "error": errors})

    return run


def translate_units(units: DataFrame, cache: DataFrame | None, provider: Provider, source: str, target: str, names: tuple[str, str], slots: int = 8, attempts: int = ATTEMPTS, retry_pause: float = RETRY_PAUSE, call_pause: float = CALL_PAUSE) -> tuple[DataFrame, DataFrame]:
    """(units with chunk_hash, translation, status, attempts, error, from_cache, anomalies; new cache rows).

    Each distinct text that the cache lacks is asked for once, in ``slots`` tasks. The calls' result is checkpointed, or a recomputed
    task would ask again; rejected and failed texts have status 'error' and enter no cache. Cached rows are checked like all others.
    """
    keyed = units.withColumn("chunk_hash", cache_key(F.col("text"), provider.name, source, target))
    known = cache.select("chunk_hash", F.col("translation").alias("cached")) if cache is not None else None
    todo = keyed.select("chunk_hash", "text").dropDuplicates(["chunk_hash"])
    if known is not None:
        todo = todo.join(known, "chunk_hash", "left_anti")
    asked = todo.withColumn("prompt", prompt(F.col("text"), F.lit(source), F.lit(target), F.lit(names[0]), F.lit(names[1]))).withColumn("budget", token_budget(F.col("text")))
    called = asked.repartition(slots, "chunk_hash").mapInPandas(_calls(provider, attempts, retry_pause, call_pause), "chunk_hash string, text string, raw string, attempts int, error string").checkpoint()
    done = called.withColumn("translation", scrub(F.col("raw"))).withColumn("error", F.coalesce("error", quality.guard_error(F.col("text"), F.col("translation"))))
    fresh = done.where(F.col("error").isNull()).select("chunk_hash", "translation")
    out = keyed.join(done.select("chunk_hash", F.col("translation").alias("_new"), "attempts", "error"), "chunk_hash", "left")
    if known is not None:
        out = out.join(known, "chunk_hash", "left").withColumn("from_cache", F.col("cached").isNotNull()).withColumn("translation", F.coalesce("cached", F.when(F.col("error").isNull(), F.col("_new")))).drop("cached")
    else:
        out = out.withColumn("from_cache", F.lit(False)).withColumn("translation", F.when(F.col("error").isNull(), F.col("_new")))
    status = F.when(F.col("translation").isNotNull(), "ok").otherwise("error")
    checks = F.when(F.col("translation").isNotNull(), quality.anomalies(F.col("text"), F.col("translation"))).otherwise(F.array().cast("array<string>"))
    return out.drop("_new").withColumn("status", status).withColumn("anomalies", checks), fresh


def lookup(units: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """units with chunk_hash, the digest of the text alone, and the cached translation, null where there is none."""
    return units.withColumn("chunk_hash", digest(F.col(text))).join(cache.select("chunk_hash", "translation"), "chunk_hash", "left")


def hits(units: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    return units.withColumn("chunk_hash", digest(F.col(text))).join(cache, "chunk_hash", "left_semi")


def misses(units: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """One row for each distinct text that the cache lacks. Duplicates go first, in their tasks; the anti join then uses their shuffle."""
    return units.withColumn("chunk_hash", digest(F.col(text))).dropDuplicates(["chunk_hash"]).join(cache.select("chunk_hash"), "chunk_hash", "left_anti")


def error_mark(n: Column, text: Column) -> Column:
    """What stands in the output for a text that failed. The wording is a fixed value."""
    return F.concat(F.format_string("[ERROR DE TRADUCCIÓN EN CHUNK %d]\n\n", n), text)


def suspicious(checked: DataFrame, number: Column, reference: Column | None = None, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(extra, chunk, original, translation, anomalies, reference) of the rows with anomalies; texts are cut to 120 characters."""
    rows = checked.where(F.size("anomalies") > 0)
    ref = F.lit(None).cast("string") if reference is None else reference
    return rows.select(*(c for c in extra if c in checked.columns), number.cast("int").alias("chunk"), F.substring("text", 1, 120).alias("original"), F.substring("translation", 1, 120).alias("translation"), "anomalies", ref.alias("reference"))


def report(rows: DataFrame, by: list[str], title: Column) -> DataFrame:
    """(by, section, chunk, entry): the lines of the text report of suspicious rows: 0 the head, 1 each row's entry, 2 the total.

    In order of section and chunk they make up a file; no task holds a report. The wording is a fixed value.
    """
    ref = F.coalesce("reference", F.format_string("Chunk %d", F.col("chunk")))
    entry = F.concat(F.lit("👁️  "), ref, F.lit("\n   Anomalías: "), F.array_join("anomalies", ", "), F.lit("\n   Original:    "), F.col("original"), F.lit("...\n   Traducción:  "), F.col("translation"), F.lit("...\n"))
    head = F.concat(F.lit("Reporte de traducciones sospechosas — "), title, F.lit("\n" + "=" * 60 + "\n"))
    none = F.lit(0)
    each = rows.select(*by, F.lit(1).alias("section"), "chunk", entry.alias("entry"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    total = F.concat(F.lit("Total: "), F.col("_n").cast("string"), F.lit(" bloque(s) sospechoso(s)"))
    return each.unionByName(ends.select(*by, none.alias("section"), none.alias("chunk"), head.alias("entry"))).unionByName(ends.select(*by, F.lit(2).alias("section"), none.alias("chunk"), total.alias("entry")))


def summary(done: DataFrame, by: list[str]) -> DataFrame:
    """Units, done and failed counts, and suspicious counts."""
    bad = F.col("status") == "error"
    return done.groupBy(*by).agg(F.count("*").alias("n_units"), F.count_if(~bad).alias("n_ok"), F.count_if(bad).alias("n_errors"), F.count_if(F.size("anomalies") > 0).alias("n_suspicious"))


def failures(done: DataFrame, by: list[str], number: str = "pos") -> DataFrame:
    """(by, chunk): the numbers, from 1, of the units that failed."""
    return done.where("status = 'error'").select(*by, (F.col(number) + 1).alias("chunk"))
