"""Models outside the engine: a chat server over HTTP, and recognisers of speech and of text in pictures, as functions passed in.

Nothing here imports a model. Every operator takes a function a worker can import, gives it one item at a time, and turns a failure into a
note beside the rows of the others.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# Recogniser packs of each script, and the mean word confidence from which a reading is believed.
SCRIPT_PACKS = {"latin": ("eng", "deu", "fra", "spa", "ita"), "cyrillic": ("rus",), "han": ("chi_sim",), "japanese": ("jpn",), "devanagari": ("hin",)}
CONFIDENT = 75.0


class ChatModel:
    """model(messages) for ``agent.react``: a server that speaks the common /api/chat protocol. Failing calls are tried again, then raise."""

    def __init__(self, host: str, model: str, temperature: float = 0.2, most_tokens: int = 512, timeout: float = 600.0, tries: int = 3):
        self.host, self.model, self.timeout, self.tries = host.rstrip("/"), model, timeout, tries
        self.options = {"temperature": temperature, "num_predict": most_tokens}

    def _lines(self, messages: list[tuple[str, str]], stream: bool) -> Iterator[dict]:
        body = {"model": self.model, "messages": [{"role": r, "content": c} for r, c in messages], "stream": stream, "options": self.options}
        request = urllib.request.Request(f"{self.host}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            for line in answer:
                if line.strip():
                    yield json.loads(line)

    def __call__(self, messages: list[tuple[str, str]]) -> str:
        for left in range(self.tries - 1, -1, -1):
            try:
                return "".join(x.get("message", {}).get("content", "") for x in self._lines(messages, False))
            except OSError:
                if not left:
                    raise
        return ""

    def pieces(self, messages: list[tuple[str, str]]) -> Iterator[str]:
        """The answer piece by piece, as the server sends it."""
        for x in self._lines(messages, True):
            yield x.get("message", {}).get("content", "")


# -- sound ------------------------------------------------------------------------------------------------------------------


def wave_samples(content: bytes, rate: int = 16_000) -> np.ndarray:
    """One channel of float32 samples at ``rate`` from a PCM wave file: channels are averaged; other rates are averaged over the width of
    a new sample, then interpolated."""
    import io
    import wave

    with wave.open(io.BytesIO(content)) as w:
        width, channels, old = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2.0 ** (8 * width - 1)
    else:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2.0**23
    x = x.reshape(-1, channels).mean(1)
    if old == rate or not len(x):
        return x.astype(np.float32)
    wide = max(1, round(old / rate))
    smooth = np.convolve(x, np.ones(wide) / wide, "same") if wide > 1 else x
    at = np.arange(round(len(x) * rate / old)) * (old / rate)
    return np.interp(at, np.arange(len(x)), smooth).astype(np.float32)


def sound_files(spark: SparkSession, folder: str, rate: int = 16_000, seconds_each: int = 30, decoder: Callable[[bytes, int], np.ndarray] | None = None, pattern: str = "*.wav") -> DataFrame:
    """(source, part, start_sec, samples array<float>, warning): recordings cut into pieces of bounded length; unreadable files have a warning."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["source", "part", "start_sec", "samples", "warning"]
        for p in batches:
            for path, content in zip(p["path"], p["content"]):
                try:
                    x = (decoder or wave_samples)(bytes(content), rate)
                except Exception as e:
                    yield pd.DataFrame([(path, None, None, None, f"unreadable: {type(e).__name__}")], columns=cols).astype({"part": "Int32", "start_sec": float})
                    continue
                step = rate * seconds_each
                yield pd.DataFrame([(path, i // step, i / rate, x[i : i + step], None) for i in range(0, max(len(x), 1), step)], columns=cols).astype({"part": "Int32"})

    return raw.select("path", "content").mapInPandas(run, "source string, part int, start_sec double, samples array<float>, warning string")


_SPOKEN = "media_id string, segment_id bigint, start_sec double, end_sec double, text string, note string"


def transcribed(recordings: DataFrame, transcriber: Callable[[str, str | None], list[tuple[float, float, str]]]) -> DataFrame:
    """recordings (media_id, path, on_screen, hint) -> segments, or a note where there are none: ``speech_failed`` or ``no_speech``.

    ``transcriber(path, language)`` gives (start, end, text). The language is that of the text on screen if it is clear, else the hint.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows: list[tuple] = []
            for media, path, lang in zip(p["media_id"], p["path"], p["lang"]):
                try:
                    said = [(float(a), float(b), t.strip()) for a, b, t in transcriber(path, lang) if t.strip()]
                except Exception:
                    rows.append((media, None, None, None, None, "speech_failed"))
                    continue
                rows += [(media, i, a, b, t, None) for i, (a, b, t) in enumerate(said)] or [(media, None, None, None, None, "no_speech")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SPOKEN.split(", ")]).astype({"segment_id": "Int64", "start_sec": float, "end_sec": float})

    lang = F.coalesce(X.language_confident(F.coalesce("on_screen", F.lit("")), 2), "hint")
    return recordings.select("media_id", "path", lang.alias("lang")).mapInPandas(run, _SPOKEN)


# -- text in pictures ---------------------------------------------------------------------------------------------------------


def packs_of(script: Column, installed: list[str]) -> Column:
    """The installed packs of a script, joined by '+': English goes with every other script; null without a pack or a script."""
    out = F.lit(None).cast("string")
    for name, packs in SCRIPT_PACKS.items():
        have = [p for p in packs if p in installed] + (["eng"] if name != "latin" and "eng" in installed else [])
        if have:
            out = F.when(script == name, "+".join(have)).otherwise(out)
    return out


def read_frames(frames: DataFrame, recogniser: Callable[[bytes, str], tuple[str, float]], installed: list[str]) -> DataFrame:
    """frames (media_id, keyframe_id, ts_sec, image) -> (media_id, keyframe_id, text, packs).

    ``recogniser(image, packs)`` gives a text and its mean word confidence. A frame is first read with every known pack; the script of that
    reading names fewer packs, whose reading counts where it is surer than the first or the first is empty. Frames don't wait for one
    another, so a recording needs no order and no state.
    """
    known = [p for ps in SCRIPT_PACKS.values() for p in ps if p in installed] or list(installed)
    shape = "media_id string, keyframe_id bigint, image binary, text string, confidence double"

    def read(again: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                rows = []
                for r in p.itertuples(index=False):
                    packs = r.packs if again else "+".join(known)
                    text, sure = ("", 0.0) if not again else (r.text, r.confidence)
                    if packs and (not again or r.confidence < CONFIDENT or len(packs) < len("+".join(known))):
                        try:
                            new, better = recogniser(bytes(r.image), packs)
                            if not again or better >= sure or not text:
                                text, sure = new, better
                        except Exception:
                            pass
                    rows.append((r.media_id, r.keyframe_id, r.image, text, sure))
                yield pd.DataFrame(rows, columns=["media_id", "keyframe_id", "image", "text", "confidence"])
        return run

    first = frames.where("image is not null").select("media_id", F.col("keyframe_id").cast("bigint").alias("keyframe_id"), "image", F.lit("").alias("packs")).mapInPandas(read(False), shape)
    fewer = packs_of(X.script_of(F.col("text")), known)
    second = first.withColumn("packs", F.when(fewer != "+".join(known), fewer))
    packs = F.coalesce(fewer, F.lit("+".join(known)))
    return second.select("media_id", "keyframe_id", "image", "packs", "text", "confidence").mapInPandas(read(True), shape).select("media_id", "keyframe_id", "text", packs.alias("packs"))
