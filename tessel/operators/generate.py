"""Batched text generation with a model loaded once for each Python worker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Decoding:
    """Settings handed to the generator. Presets: ROW, BATCH."""

    max_new_tokens: int = 256
    temperature: float = 0.3
    top_p: float = 0.9
    do_sample: bool = False
    batch_size: int = 1


ROW = Decoding()
BATCH = Decoding(max_new_tokens=128, temperature=0.2, batch_size=8)

Generator = Callable[[list[str], Decoding], list[str]]


def generator(load: Callable[[], Generator], decoding: Decoding = BATCH) -> Callable[[Column], Column]:
    """A Column function that generates text for prompts.

    `load` runs once in each worker; an error in it fails the task. A null prompt
    is not generated from and gives null. The function
    is marked nondeterministic, or a filter on its output would plan it twice.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def predict(prompts: np.ndarray) -> np.ndarray:
            asked = [i for i, p in enumerate(prompts) if p is not None]
            out = np.full(len(prompts), None, dtype=object)
            if asked:
                out[asked] = model([str(prompts[i]) for i in asked], decoding)
            return out

        return predict

    udf = predict_batch_udf(make, return_type=StringType(), batch_size=decoding.batch_size)
    return udf.asNondeterministic() if hasattr(udf, "asNondeterministic") else udf


@dataclass(frozen=True)
class Model:
    """Which model a worker loads, and how. `four_bit` loads quantised weights and computes in `dtype`."""

    name: str
    dtype: str = "float16"
    device_map: str = "auto"
    cache_dir: str | None = None
    four_bit: bool = False


def text_model(settings: Model, libraries: Callable[[str], object] = import_module) -> Callable[[], Generator]:
    """A `load` for `generator`: a causal language model behind a text-generation pipeline.

    The libraries are imported, and the model is loaded, in the worker; what fails there fails the task.
    """

    def load() -> Generator:
        torch, lib = libraries("torch"), libraries("transformers")
        dtype = getattr(torch, settings.dtype)
        options = {"device_map": settings.device_map, "cache_dir": settings.cache_dir, "torch_dtype": dtype}
        if settings.four_bit:
            options["quantization_config"] = lib.BitsAndBytesConfig(load_in_4bit=True, bnb_4bit_compute_dtype=dtype)
        weights = lib.AutoModelForCausalLM.from_pretrained(settings.name, **options)
        words = lib.AutoTokenizer.from_pretrained(settings.name, cache_dir=settings.cache_dir)
        run = lib.pipeline("text-generation", model=weights, tokenizer=words)

        def generate(prompts: list[str], d: Decoding) -> list[str]:
            said = run(prompts, max_new_tokens=d.max_new_tokens, temperature=d.temperature, top_p=d.top_p, do_sample=d.do_sample, batch_size=d.batch_size)
            return [first[0]["generated_text"] for first in said]

        return generate

    return load


def load_stub() -> Generator:
    """Echoes the prompt and answers with the number of its characters modulo 13."""
    return lambda prompts, _: [f"{p} 정답은 {len(p) % 13}번" for p in prompts]
