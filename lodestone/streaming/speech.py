"""Speech segments from streams of audio frames, and queries as they come.

Frames have session, ts and pcm (16-bit little-endian samples). A frame is speech if its root mean square is over
THRESHOLD. A segment begins with the first speech frame and ends with a silent frame more than GAP after the last one;
as a stream may just stop, a watermark closes what is open after GAP as well.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.answer import Index, answer

THRESHOLD, FULL, GAP_MS = 600.0, 6000.0, 1400
EVENTS = "session string, event string, ts timestamp, level double"
#: Languages of a transcript where none is named, and the confidence of a service that gives none.
ENGLISH, HINDI, UNNAMED, CONFIDENCE = "en-IN", "hi-IN", ("", "unknown", "auto"), 0.95


def rms(pcm: bytes | None) -> float:
    """Of 16-bit samples; 0 for none."""
    if not pcm or len(pcm) < 2:
        return 0.0
    x = np.frombuffer(pcm[: len(pcm) // 2 * 2], dtype="<i2").astype(np.float64)
    return float(np.sqrt((x * x).mean()))


def segments(frames: DataFrame, gap: str = f"{GAP_MS} milliseconds", delay: str = "10 seconds") -> DataFrame:
    """(session, started, ended, frames) of frames (session, ts, level) by session windows over speech frames, batch or stream."""
    speech = frames.filter(F.col("level") > THRESHOLD)
    if frames.isStreaming:
        speech = speech.withWatermark("ts", delay)
    found = speech.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("frames"))
    return found.select("session", "started", "ended", "frames")


def step(open_: bool, last: float, ts: float, level: float, gap_ms: float = GAP_MS) -> tuple[bool, float, list[tuple[str, float]]]:
    """One frame: whether a segment is open then, the last speech's time, and the events (name, level)."""
    if level > THRESHOLD:
        heard = ("audio_level", min(1.0, level / FULL))
        return True, ts, [heard] if open_ else [("START_SPEECH", heard[1]), heard]
    if open_ and ts - last > gap_ms:
        return False, last, [("END_SPEECH", 0.0)]
    return open_, last, []


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_, last = state.get if state.exists else (False, 0.0)
    out: list[tuple] = []
    if state.hasTimedOut:
        out = [(key[0], "END_SPEECH", pd.Timestamp(last + GAP_MS, unit="ms"), 0.0)] if open_ else []
        state.remove()
    else:
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, level in zip(rows["ts"], rows["level"], strict=True):
            open_, last, events = step(open_, last, ts.timestamp() * 1000, level)
            out += [(key[0], name, ts, value) for name, value in events]
        state.update((open_, last))
        if open_:
            state.setTimeoutTimestamp(int(max(last + GAP_MS, state.getCurrentWatermarkMs() + 1)))
    yield pd.DataFrame(out, columns=["session", "event", "ts", "level"])


def speech_events(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """START_SPEECH, audio_level and END_SPEECH of a stream of frames (session, ts, level)."""
    marked = frames.withWatermark("ts", delay).groupBy("session")
    return marked.applyInPandasWithState(_advance, EVENTS, "open boolean, last double", "append", GroupStateTimeout.EventTimeTimeout)


def leveled(frames: DataFrame) -> DataFrame:
    """Adds level to frames with pcm, in the JVM: the samples are read from the bytes' hex digits."""
    count = F.floor(F.octet_length("pcm") / 2).cast("int")
    unsigned = lambda i: F.conv(F.concat(F.substring(F.hex("pcm"), i * 4 - 1, F.lit(2)), F.substring(F.hex("pcm"), i * 4 - 3, F.lit(2))), 16, 10).cast("int")
    squares = F.transform(F.sequence(F.lit(1), count), lambda i: F.pow(unsigned(i) - F.when(unsigned(i) > 32767, 65536).otherwise(0), F.lit(2)))
    level = F.when(count > 0, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / count)).otherwise(0.0)
    return frames.withColumn("level", level)


def control_events(messages: DataFrame, language: str = "unknown") -> DataFrame:
    """(session, ts, event, streaming, language) of text messages (session, ts, message): start and stop, as JSON under type.

    start may name the session's language, which holds until another does; before any, it is the one given. Messages that
    are not JSON objects, or of another type, are passed over. Of one session and time, start comes before stop.
    """
    read = F.from_json("message", "type string, language string")
    found = messages.select("session", "ts", read.alias("m")).filter(F.col("m.type").isin("start", "stop"))
    named = F.when(F.col("m.type") == "start", F.nullif("m.language", F.lit("")))
    so_far = Window.partitionBy("session").orderBy("ts", "m.type").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("session", "ts", F.col("m.type").alias("event"), (F.col("m.type") == "start").alias("streaming"), F.coalesce(F.last(named, ignorenulls=True).over(so_far), F.lit(language)).alias("language"))


def transcribe(audio: DataFrame, recognise: Callable[[bytes, str, str], dict] | None = None, provider: str = "service") -> DataFrame:
    """Adds transcript, spoken, latency_ms, provider and confidence to rows with audio (binary), mime and language, batch or stream.

    recognise takes the bytes, their type (audio/wav unless given) and a language (English where none is named) and gives
    a dict of transcript or text, language_code and confidence. Where there is no such function, or it fails for a row,
    the row has the fallback: an empty transcript in Hindi or English, of provider "fallback" and confidence 0.
    """
    made = ["transcript", "spoken", "latency_ms", "provider", "confidence"]
    kept = [f for f in audio.schema.fields if f.name not in made]

    def one(sound: bytes | None, mime: str | None, asked: str) -> tuple:
        began = time.perf_counter()
        latency = lambda: round((time.perf_counter() - began) * 1000, 2)
        if recognise is not None:
            try:
                got = recognise(bytes(sound or b""), mime or "audio/wav", ENGLISH if asked in UNNAMED else asked)
                return got.get("transcript") or got.get("text") or "", got.get("language_code") or asked or ENGLISH, latency(), provider, float(got.get("confidence") or CONFIDENCE)
            except Exception:  # whatever a service raises, the row has its fallback
                pass
        return "", HINDI if asked == HINDI else ENGLISH, latency(), "fallback", 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(*r) for r in zip(pdf["audio"], pdf["mime"], (x or "" for x in pdf["language"]), strict=True)]
            yield pdf.assign(**{name: [r[k] for r in rows] for k, name in enumerate(made)})

    schema = T.StructType([*kept, T.StructField("transcript", T.StringType()), T.StructField("spoken", T.StringType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("provider", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return audio.select(*[F.col(f"`{f.name}`") for f in kept]).mapInPandas(run, schema)


def answer_stream(queries: DataFrame, index: Index, sink, checkpoint: str):
    """Starts a stream that answers queries (query_id, query) batch by batch; sink(df, batch_id) takes the answers."""
    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(answer(df, index), n)).start()
