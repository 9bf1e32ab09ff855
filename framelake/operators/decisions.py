"""Decisions of a sender that hang on the one before: mode and low-rate copies, with hysteresis. Each row is a map from the state before to the state
after; maps are composed by scan(), so that a sequential rule needs no task that sees a whole stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.scan import followed, scan

#: Rate from which a mode is right for music, for voice in mono and for voice in stereo; what a telephone adds; how far the mode before moves it.
MUSIC_RATE, MONO_VOICE_RATE, STEREO_VOICE_RATE, TELEPHONE, HOLD = 10_000, 64_000, 44_000, 8_000, 4_000
#: Rate from which a low-rate copy is affordable at each bandwidth, narrow to full, and how far the last decision moves it.
COPY_RATES, COPY_HOLD = (12_000, 14_000, 16_000, 20_000, 22_000), 1_000
#: Bits a second under which only celt is left, up to 50 frames a second and above.
LEAST_RATE, LEAST_RATE_SHORT = 6_000, 9_000
NONE, SILK, CELT = range(3)


def decide_modes(frames: DataFrame, telephone: bool = False, music_safe: bool = False, rate: int = 48_000) -> DataFrame:
    """Add mode (silk or celt) to frames(stream_id, seq, rate, voice, width, fec, loss, dtx, max_bytes, samples), whose seq numbers a stream densely from 0.

    rate is in bits a second, voice a likelihood of 0 to 127, width of the stereo image 0 to 1, loss in percent, max_bytes what a packet may have. celt
    from a threshold on, which is higher the likelier voice is and moves with the mode before; copies against loss and suppressed silence of
    voice want silk; packets too small or shorter than 10 ms are celt. Null switches count as off, other nulls give no mode but celt."""
    c = F.col
    voice_rate = F.floor((1 - c("width")) * MONO_VOICE_RATE + c("width") * STEREO_VOICE_RATE + 0.5).cast("long")
    level = MUSIC_RATE + F.floor(c("voice") * c("voice") * (voice_rate - MUSIC_RATE) / 16384) + (TELEPHONE if telephone else 0)
    lossy = c("fec") & (c("loss") > F.floor((128 - c("voice")) / 16)) & ((c("voice") > 25) if music_safe else F.lit(True))
    wants_silk = F.coalesce(lossy, F.lit(False)) | F.coalesce(c("dtx") & (c("voice") > 100), F.lit(False))
    least = F.floor(F.floor(F.when(F.floor(rate / c("samples")) > 50, LEAST_RATE_SHORT).otherwise(LEAST_RATE) * 6 / F.floor(6 * rate / c("samples"))) / 8)
    only_celt = (c("max_bytes") < least) | (c("samples") < rate // 100)

    def after(move: int) -> Column:
        mode = F.when(c("rate") >= level + move, CELT).when(c("rate").isNotNull() & level.isNotNull(), SILK).otherwise(CELT)
        return F.when(only_celt, CELT).when(wants_silk, SILK).otherwise(mode)

    rows = scan(frames, "stream_id", "seq", F.array(after(0), after(HOLD), after(-HOLD)), followed, "_map")
    return rows.withColumn("mode", F.when(F.get("_map", F.lit(NONE)) == SILK, "silk").otherwise("celt")).drop("_map")


def decide_copies(frames: DataFrame) -> DataFrame:
    """Add copy, whether a low-rate copy of the frame before is sent, and sent_bandwidth, to frames(stream_id, seq, mode, bandwidth, rate, fec, loss).

    bandwidth is 0 (narrow) to 4 (full). A copy is sent where the rate is above a threshold, which is lower with more loss and where the last frame had one; with
    more than 5 % loss a lower bandwidth is taken if only that makes it affordable. celt, no loss and fec off: none. Nulls: none."""
    c = F.col
    base = F.array(*map(F.lit, COPY_RATES))

    def affordable(move: int) -> Column:
        level = lambda b: F.floor((F.get(base, b) + move) * (125 - F.least(c("loss"), F.lit(25))) / 100)
        lowest = F.when(c("loss") <= 5, c("bandwidth")).otherwise(0)
        tried = F.transform(F.sequence(c("bandwidth").cast("int"), lowest.cast("int"), F.lit(-1)), lambda b: F.when(c("rate") > level(b), b + 1))
        found = F.coalesce(F.get(F.array_compact(tried), F.lit(0)), F.lit(0))
        return F.when(c("fec") & (c("loss") > 0) & (c("mode") != "celt") & c("bandwidth").between(0, 4), found).otherwise(0)

    # state 0: none; 1 + b: one, sent at bandwidth b
    rows = frames.withColumns({"_off": affordable(COPY_HOLD), "_on": affordable(-COPY_HOLD)})
    rows = scan(rows, "stream_id", "seq", F.concat(F.array("_off"), F.array_repeat("_on", len(COPY_RATES))), followed, "_map")
    state = F.get("_map", F.lit(0))
    return rows.withColumn("copy", state > 0).withColumn("sent_bandwidth", F.when(state > 0, state - 1).otherwise(c("bandwidth")).cast("int")).drop("_map", "_off", "_on")


def frame_size(given: Column, wanted: Column, silk_only: Column, rate: int = 48_000) -> Column:
    """Samples of the frames that an input of `given` samples is coded in: `wanted` tenths of milliseconds, or all of it for null. Null for an input below
    2.5 ms, a size that isn't 2.5, 5, 10, 20, 40, 60, 80, 100 or 120 ms, one above the input, or one below 10 ms where only silk may code."""
    sizes = [rate * x // 10_000 for x in (25, 50, 100, 200, 400, 600, 800, 1000, 1200)]
    chosen = F.coalesce(F.floor(wanted * rate / 10_000), given).cast("long")
    good = (given >= rate // 400) & (chosen <= given) & chosen.isin(sizes) & ~(silk_only & (chosen < rate // 100))
    return F.when(good, chosen)


def valid_config(config: Column) -> Column:
    return config.between(0, 31)
