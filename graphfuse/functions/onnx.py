"""Embedding by an ONNX encoder: one session a worker process, whole batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import InvalidConfig

_open: dict[tuple, "Encoder"] = {}


class Encoder:
    """Tokenise, run, take the first token's row, normalise.  ``run`` can be replaced, as tests do."""

    def __init__(self, model_path: str, tokenizer_path: str, dim: int, most_tokens: int = 512, run: Callable | None = None, tokenizer=None):
        if tokenizer is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
        if run is None:
            import onnxruntime

            session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
            wanted = {i.name for i in session.get_inputs()}
            width = session.get_outputs()[0].shape[-1]
            if isinstance(width, int) and width != dim:
                raise InvalidConfig(f"the model gives {width} dimensions, {dim} are set")
            run = lambda feed: session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
        self.tokenizer, self.run, self.dim = tokenizer, run, dim
        self.tokenizer.enable_truncation(most_tokens)
        self.tokenizer.enable_padding()

    def __call__(self, texts: list[str]) -> np.ndarray:
        got = self.tokenizer.encode_batch(texts)
        ids = np.array([e.ids for e in got], np.int64)
        feed = {"input_ids": ids, "attention_mask": np.array([e.attention_mask for e in got], np.int64), "token_type_ids": np.zeros_like(ids)}
        rows = np.asarray(self.run(feed))[:, 0, :]
        if rows.shape[1] != self.dim:
            raise InvalidConfig(f"the model gives {rows.shape[1]} dimensions, {self.dim} are set")
        return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def onnx_embed(text: Column | str, model_path: str, tokenizer_path: str, dim: int, batch: int = 64) -> Column:
    """Vectors of a text column; null stays null."""

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (model_path, tokenizer_path, dim)
        if key not in _open:
            _open[key] = Encoder(*key)
        for s in series:
            out: list = [None] * len(s)
            known = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(known), batch):
                part = known[k : k + batch]
                for i, v in zip(part, _open[key]([s.iloc[j] for j in part]), strict=True):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return embed(F.col(text) if isinstance(text, str) else text)
