"""Model-assisted steps behind a replaceable client: prompts, cached calls, retries and the reading of responses."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.text import llm_key, vlm_key
from sheetweave.operators import cache

MAX_IMAGE_BYTES = 20 * 1024 * 1024
FAILED = "[画像概要] 解析失敗。"
TOO_LARGE = "[画像概要] 画像が大きすぎます。"
RETRIES, FIRST_WAIT = 3, 2.0
_JSON = re.compile(r"```json\s*(.*?)```", re.S)
_YAML = re.compile(r"```yaml\s*(.*?)```", re.S)


class Client(Protocol):
    """What a model client offers; it is pickled to the executors."""

    def complete(self, model: str, prompt: str, text: str, images: list[bytes]) -> str: ...


class ModelError(Exception):
    """A failed call with its HTTP status, if there was one."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


class FakeClient:
    """A deterministic stand-in: answers with the length of what it was given."""

    def complete(self, model: str, prompt: str, text: str, images: list[bytes]) -> str:
        return json.dumps({"data": [{"model": model, "chars": len(text), "images": len(images)}]})


class NoClient:
    """Stands where no model was given: a sheet or an image that needs one ends the job."""

    def complete(self, model: str, prompt: str, text: str, images: list[bytes]) -> str:
        raise RuntimeError("this input needs a model, but no client and no base URL was given")


WANTED_FORM = "Answer with one fenced json block."


def messages(prompt: str, text: str, images: list[bytes]) -> list[dict]:
    """The messages of a request: system, then the text, the images and, for texts, the wanted form."""
    import base64

    parts: list[dict] = [{"type": "text", "text": text}] if text else [{"type": "text", "text": prompt}]
    parts += [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(i).decode()}} for i in images]
    if not text:
        return [{"role": "user", "content": parts}]
    return [{"role": "system", "content": prompt}, {"role": "user", "content": [*parts, {"type": "text", "text": WANTED_FORM}]}]


class HttpClient:
    """A client of any server with the common chat-completions interface."""

    def __init__(self, base_url: str, api_key: str | None = None, timeout: float = 600) -> None:
        self.url, self.key, self.timeout = base_url.rstrip("/") + "/chat/completions", api_key, timeout

    def complete(self, model: str, prompt: str, text: str, images: list[bytes]) -> str:
        from urllib import error, request

        body = {"model": model, "messages": messages(prompt, text, images)}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with request.urlopen(request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:
                return json.loads(r.read())["choices"][0]["message"]["content"] or ""
        except error.HTTPError as e:
            raise ModelError(f"{e.code} {e.reason}", e.code) from e
        except (OSError, ValueError, KeyError, IndexError) as e:
            raise ModelError(str(e)) from e


def with_retries(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
    """Call again after 2, 4 and 8 seconds while the failure may pass (no status, 429, 5xx)."""
    for n in range(RETRIES + 1):
        try:
            return call()
        except ModelError as e:
            passing = e.status is None or e.status == 429 or 500 <= e.status < 600
            if not passing or n == RETRIES:
                raise
            sleep(FIRST_WAIT * 2**n)
    raise AssertionError


def prompt_messages(prompt: Column, html: Column, notes: Column, images: Column) -> Column:
    """The messages of a request: system, then the sheet with its notes, the page images and the wanted form."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("content"))
    body = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(html, F.lit("\n\n"), notes)).otherwise(html)
    head = F.array(part("system", prompt), part("text", body))
    return F.concat(head, F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda u: part("image_url", u)), F.array(part("text", F.lit(WANTED_FORM))))


def read_response(content: str, sheet: str | None = None) -> dict:
    """A response as ``{data | error, _raw_data}``: the first JSON block, else the first YAML block or the whole text as YAML."""
    value, raw = None, content
    if m := _JSON.search(content):
        try:
            value, raw = json.loads(m.group(1)), m.group(1).strip()
        except ValueError:
            value = None
    if value is None:
        import yaml

        m = _YAML.search(content)
        raw = m.group(1).strip() if m else content
        try:
            value = yaml.safe_load(raw)
        except (yaml.YAMLError, ValueError) as e:
            return {"error": f"Parse failed: {str(e).splitlines()[0]}", "_raw_data": content}
    if not isinstance(value, dict):
        value = {"data": value}
    if isinstance(value.get("sheets"), dict) and sheet in value["sheets"]:
        value = value["sheets"][sheet] if isinstance(value["sheets"][sheet], dict) else {"data": value["sheets"][sheet]}
    if "data" not in value and "error" not in value:
        value = {"data": value}
    if "data" in value and value["data"] is not None and not isinstance(value["data"], (list, dict)):
        return {"error": "Validation failed: data must be a list or an object", "_raw_data": raw}
    return {k: value[k] for k in ("data", "error") if value.get(k) is not None} | {"_raw_data": raw}


def parsed(responses: DataFrame, content: str = "content", sheet: str | None = None) -> DataFrame:
    """Add ``data`` (JSON), ``error`` and ``raw_data``. Bare and fenced JSON objects are read in the JVM, the rest in Arrow batches."""

    @F.pandas_udf("data string, error string, raw_data string")
    def slow(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, name in batches:
            rows = [({} if t is None else read_response(t, n)) for t, n in zip(text, name)]
            yield pd.DataFrame({"data": [json.dumps(r["data"], ensure_ascii=False, default=str) if "data" in r else None for r in rows], "error": [r.get("error") if r.get("error") is None else str(r["error"]) for r in rows], "raw_data": [r.get("_raw_data") for r in rows]})

    t = F.col(content)
    block = F.trim(F.when(t.contains("```json"), F.regexp_extract(t, r"(?s)```json\s*(.*?)```", 1)).otherwise(F.when(F.ltrim(t).startswith("{"), t)))
    obj = F.from_json(block, "data string, error string, sheets string")
    names = F.json_object_keys(block)
    easy = F.coalesce(names.isNotNull() & F.array_contains(names, "data") & ~F.array_contains(names, "error") & ~F.array_contains(names, "sheets") & F.ltrim(obj["data"]).rlike(r"^[\[{]"), F.lit(False))
    name = F.col(sheet) if sheet else F.lit(None).cast("string")
    own = F.struct(obj["data"].alias("data"), F.lit(None).cast("string").alias("error"), block.alias("raw_data"))
    return responses.withColumn("_p", F.when(easy, own).otherwise(slow(F.when(~easy, t), name))).select(*responses.columns, "_p.*")


def extracted(sheets: DataFrame, client: Client, model: str, prompt: str, stored: DataFrame | None = None, concurrency: int = 8, rounds: int = 2, notes: str = "") -> DataFrame:
    """Structured data of sheets (file_id, sheet_name, html, is_simple, simple_json): cache_key, content, data, error, raw_data.

    Simple sheets bypass the model, cached ones the call; the rest goes through at most ``concurrency`` clients at a time.
    ``notes`` follow the sheet in each request.
    """
    easy = sheets.filter("is_simple").select("file_id", "sheet_name", F.lit(None).cast("string").alias("cache_key"), F.lit(None).cast("string").alias("content"), F.concat(F.lit('{"data": '), F.col("simple_json"), F.lit("}")).alias("data"), F.lit(None).cast("string").alias("error"), F.lit("").alias("raw_data"))
    asked = sheets.filter("not coalesce(is_simple, false)").select("file_id", "sheet_name", "html", llm_key(F.lit(model), F.lit(prompt), F.col("html")).alias("cache_key"))
    hit = cache.hits(asked, stored).select("file_id", "sheet_name", "cache_key", "content") if stored is not None else None
    todo = cache.misses(asked, stored) if stored is not None else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for html, name in zip(b["html"], b["sheet_name"]):
                asked_for = f"{html or ''}\n\n{notes}" if notes else html or ""
                text, answer = asked_for, None
                for _ in range(rounds):
                    try:
                        answer = with_retries(lambda: client.complete(model, prompt, text, []))
                    except ModelError as e:
                        answer = json.dumps({"error": str(e)})
                        break
                    if "error" not in (r := read_response(answer, name)):
                        break
                    text = f"{asked_for}\n\n{r['error']}"
                out.append(answer)
            yield b[["file_id", "sheet_name", "cache_key"]].assign(content=out)

    new = todo.repartition(concurrency, "cache_key").mapInPandas(run, "file_id string, sheet_name string, cache_key string, content string")
    both = new if hit is None else hit.unionByName(new)
    return easy.unionByName(parsed(both, "content", "sheet_name"))


def summarised(images: DataFrame, client: Client, model: str, prompt: str, stored: DataFrame | None = None, concurrency: int = 8) -> DataFrame:
    """Summary of each distinct image (image_hash, bytes): image_hash, cache_key, content. Over-size images and failures get fixed texts."""
    one = images.groupBy("image_hash").agg(F.first("bytes").alias("bytes")).withColumn("cache_key", vlm_key(F.lit(model), F.lit(prompt), F.col("image_hash")))
    hit = cache.hits(one, stored).select("image_hash", "cache_key", "content") if stored is not None else None
    todo = cache.misses(one, stored) if stored is not None else one

    def ask(data: bytes | None) -> str:
        if data is not None and len(data) > MAX_IMAGE_BYTES:
            return TOO_LARGE
        try:
            return with_retries(lambda: client.complete(model, prompt, "", [data or b""]))
        except ModelError:
            return FAILED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["image_hash", "cache_key"]].assign(content=[ask(x) for x in b["bytes"]])

    new = todo.repartition(concurrency, "image_hash").mapInPandas(run, "image_hash string, cache_key string, content string")
    return new if hit is None else hit.unionByName(new)


class PageRenderer(Protocol):
    """Pages of a workbook as images; needs an office program, so none is built in."""

    def pages(self, workbook: bytes, sheet: str, dpi: int) -> list[bytes]: ...


class NoRenderer:
    """The renderer where no office program is installed."""

    def pages(self, workbook: bytes, sheet: str, dpi: int) -> list[bytes]:
        raise NotImplementedError("rendering pages needs an external office program; pass a PageRenderer")
