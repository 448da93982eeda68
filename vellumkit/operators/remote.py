"""A model behind an HTTP interface for chat completions, as one more row-to-row function."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.request import Request, urlopen

import pandas as pd

from ..sources.fetch import content_of
from .model import Model


def with_inline_images(x: Any, extra: dict | None = None) -> Any:
    """Messages of any depth with their pictures inline (P36): {type: image, image: u} becomes {type: image_url, image_url: {url: data}}, with
    ``extra`` beside it, and each file or web address becomes a data URL; what is inline stays."""
    if isinstance(x, str):
        if x.startswith(("http://", "https://", "file://")):
            return "data:image;base64," + base64.b64encode(content_of(x)).decode()
        return x
    if isinstance(x, (list, tuple)):
        return [with_inline_images(v, extra) for v in x]
    if isinstance(x, dict):
        if x.get("type") == "image" and "image" in x:
            x = {k: v for k, v in x.items() if k != "image"} | {"type": "image_url", "image_url": {"url": x["image"]}} | (extra or {})
        return {k: with_inline_images(v, extra) if k not in ("text", "type", "role") else v for k, v in x.items()}
    return x


def one_round(prompt: str, image: str | None = None, system: str | None = None, **limits: int) -> list[dict]:
    """Messages of a single question about a picture (P36); ``limits``: min_pixels, max_pixels."""
    ask = ([{"type": "image", "image": image, **limits}] if image else []) + [{"type": "text", "text": prompt}]
    return ([{"role": "system", "content": [{"type": "text", "text": system}]}] if system else []) + [{"role": "user", "content": ask}]


def payload_of(messages: list[dict], model: str | None = None, max_tokens: int | None = None, top_p: float | None = None, temperature: float = 0.0) -> dict:
    """Body of a request; what isn't given is left out."""
    given = {"model": model, "max_tokens": max_tokens, "top_p": top_p}
    return {"messages": messages, "temperature": temperature} | {k: v for k, v in given.items() if v is not None}


def http_model(base_url: str, api_key: str = "none", model: str | None = None, image: str | None = None, system: str | None = None, threads: int = 4, timeout: float = 120.0, **options: Any) -> Callable[[], Model]:
    """Factory for ``infer`` (E4): asks <base_url>/chat/completions about each row's ``prompt``, and about the picture in its column ``image``.

    Without a model's name the first that the server lists is used. A row whose request fails has no answer; a task asks with a few threads.
    """
    base = base_url.rstrip("/")
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"}

    def call(path: str, body: dict | None = None) -> dict:
        with urlopen(Request(base + path, headers=headers, data=None if body is None else json.dumps(body).encode()), timeout=timeout) as r:
            return json.load(r)

    def factory() -> Model:
        name = model or call("/models")["data"][0]["id"]

        def ask(row: tuple) -> str | None:
            try:
                messages = with_inline_images(one_round(row[0] or "", row[1], system))
                return call("/chat/completions", payload_of(messages, name, **options))["choices"][0]["message"]["content"]
            except (OSError, ValueError, KeyError, IndexError):
                return None

        def run(b: pd.DataFrame) -> pd.Series:
            pictures = b[image] if image else [None] * len(b)
            with ThreadPoolExecutor(threads) as pool:
                return pd.Series(list(pool.map(ask, zip(b["prompt"], pictures))), index=b.index, dtype="object")

        return run

    return factory
