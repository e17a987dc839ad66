"""Where responses come from: a DataFrame with a prompt column in, the same with ``response`` and ``backend_error`` out."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import closing
from dataclasses import dataclass, field
from typing import Protocol
from http import client
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Backend(Protocol):
    def generate(self, df: DataFrame, prompt_col: str = "prompt") -> DataFrame: ...


def _with_results(schema: T.StructType) -> T.StructType:
    kept = [f for f in schema.fields if f.name not in ("response", "backend_error")]
    return T.StructType([*kept, T.StructField("response", T.StringType()), T.StructField("backend_error", T.StringType())])


@dataclass(frozen=True)
class Options:
    """How a model is asked. The defaults are those of a remote model."""

    max_tokens: int = 512
    temperature: float = 0.1
    top_p: float | None = None
    greedy: bool = False
    model: str = "default"
    timeout_s: float = 600
    connect_s: float = 30
    in_flight: int = 16
    retries: int = 2


# Presets of a server, of a model in the worker, of a fine-tuned one, and of a smoke test of a checkpoint.
SERVER = Options(max_tokens=1024)
LOCAL = Options(top_p=0.9)
TUNED = Options(max_tokens=256, top_p=0.95)
GREEDY = Options(max_tokens=256, top_p=0.95, greedy=True)


def token_budget(sentence):
    """Most tokens a local model may write for a sentence: 10 and 8 for each byte."""
    return 10 + 8 * F.octet_length(sentence)


def post(url: str, body: bytes, connect_s: float, timeout_s: float) -> tuple[int, str]:
    """(status, text) of a POST, with a limit for the connection and one for each read."""
    at = urlsplit(url)
    kind = client.HTTPSConnection if at.scheme == "https" else client.HTTPConnection
    with closing(kind(at.netloc, timeout=connect_s)) as connection:
        connection.connect()
        connection.sock.settimeout(timeout_s)
        connection.request("POST", at.path + (f"?{at.query}" if at.query else ""), body, {"Content-Type": "application/json"})
        got = connection.getresponse()
        return got.status, got.read().decode(errors="replace")


def answer(text: str) -> tuple[str | None, str | None]:
    """(response, error) from a server's answer: the first choice's text, empty if there is no choice."""
    try:
        choices = json.loads(text)["choices"]
        return (choices[0]["message"]["content"] or "") if choices else "", None
    except (ValueError, KeyError, TypeError, IndexError) as e:
        return None, f"Failed to parse response from remote endpoint: {type(e).__name__}: {e}"


@dataclass(frozen=True)
class Http:
    """A server with the common chat-completions interface. Requests of a task run side by side, up to ``in_flight``.

    Errors come back in a column, after bounded retries. Write the result down before it is used twice: a second run
    of the plan would ask the model again.
    """

    endpoint: str = ""
    options: Options = field(default_factory=Options)
    endpoint_variable: str = "TOKENLOOM_ENDPOINT_URL"

    def generate(self, df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        url = (self.endpoint or os.environ.get(self.endpoint_variable, "")).rstrip("/") + "/v1/chat/completions"
        o = self.options

        def ask(prompt: str) -> tuple[str | None, str | None]:
            body = {"model": o.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": o.max_tokens, "temperature": o.temperature}
            if o.greedy:
                body["temperature"] = 0.0
            elif o.top_p is not None:
                body["top_p"] = o.top_p
            said = None
            for attempt in range(o.retries + 1):
                try:
                    status, text = post(url, json.dumps(body).encode(), o.connect_s, o.timeout_s)
                    if 200 <= status < 300:
                        return answer(text)
                    said = f"Remote endpoint returned error {status}: {text[:500]}"
                    if status < 500:
                        break
                except (OSError, client.HTTPException) as e:
                    said = f"{type(e).__name__}: {e}"
                if attempt < o.retries:
                    time.sleep(min(0.2 * 2**attempt, 5))
            return None, said

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(o.in_flight) as pool:
                for frame in frames:
                    got = list(pool.map(ask, frame[prompt_col]))
                    yield frame.assign(response=[g[0] for g in got], backend_error=[g[1] for g in got])

        return df.mapInPandas(run, _with_results(df.schema))


@dataclass(frozen=True)
class Local:
    """A model in the Python worker: ``load`` runs once in each task and returns a function of (prompts, most tokens of each).

    Prompts go to it in batches; sentences of a batch may be of any length. The budget follows each sentence's bytes.
    """

    load: Callable[[], Callable[[list[str], list[int]], list[str]]]
    batch_size: int = 32

    def generate(self, df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        load, size = self.load, self.batch_size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for frame in frames:
                out: list[str] = []
                for i in range(0, len(frame), size):
                    out += model(frame[prompt_col].iloc[i : i + size].tolist(), frame["_budget"].iloc[i : i + size].tolist())
                yield frame.drop(columns="_budget").assign(response=out, backend_error=None)

        text = F.col("sentence") if "sentence" in df.columns else F.col(prompt_col)
        return df.withColumn("_budget", F.coalesce(token_budget(text), F.lit(10))).mapInPandas(run, _with_results(df.schema))


@dataclass(frozen=True)
class Transformers:
    """A causal model by the transformers library, which has to be installed on the executors; an adapter is merged if given."""

    path: str
    options: Options = LOCAL
    adapter: str | None = None
    batch_size: int = 8

    def generate(self, df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        path, adapter, o = self.path, self.adapter, self.options

        def load():
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer

            cuda = torch.cuda.is_available()
            tokenizer = AutoTokenizer.from_pretrained(path, padding_side="left")
            model = AutoModelForCausalLM.from_pretrained(path, torch_dtype=torch.float16 if cuda else torch.float32).to("cuda" if cuda else "cpu")
            if adapter:
                from peft import PeftModel

                model = PeftModel.from_pretrained(model, adapter).merge_and_unload()

            def ask(prompts: list[str], budgets: list[int]) -> list[str]:
                given = tokenizer(prompts, return_tensors="pt", padding=True).to(model.device)
                how = {"do_sample": False} if o.greedy else {"do_sample": True, "temperature": o.temperature, "top_p": o.top_p}
                made = model.generate(**given, max_new_tokens=max(budgets), pad_token_id=tokenizer.pad_token_id, **how)
                return tokenizer.batch_decode(made[:, given["input_ids"].shape[1] :], skip_special_tokens=True)

            return ask

        return Local(load, self.batch_size).generate(df, prompt_col)


@dataclass(frozen=True)
class Replay:
    """Recorded responses (prompt, response), joined on the prompt; prompts without one get an error."""

    recorded: DataFrame

    def generate(self, df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        r = self.recorded.select(F.col("prompt").alias("_prompt"), F.col("response")).dropDuplicates(["_prompt"])
        out = df.join(r, F.col(prompt_col) == F.col("_prompt"), "left").drop("_prompt")
        return out.withColumn("backend_error", F.when(F.col("response").isNull(), "no recorded response"))


@dataclass(frozen=True)
class Synthetic:
    """Responses by a column expression: a stand-in for a model, for tests and benchmarks."""

    response: Callable[[], object]

    def generate(self, df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        return df.withColumn("response", self.response()).withColumn("backend_error", F.lit(None).cast("string"))
