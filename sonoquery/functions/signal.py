"""Signal functions on ``array<double>`` columns, as Catalyst expressions.

Arrays are mono waveforms or impulse responses.  Rounding of sample counts is
half to even (``bround``).  Undefined descriptors are NaN, inapplicable ones
null, and conditions that are errors raise when the row is evaluated.

Arguments are Columns.  What a function needs of a whole array within a lambda is bound
to a variable first (:func:`bound`): Catalyst puts expressions of ``withColumn`` into the
lambda, where they would be evaluated for each sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
SPEED_OF_SOUND = 343.0


def _nan() -> Column:
    return F.expr("double('NaN')")


def _error(message: str) -> Column:
    return F.raise_error(F.lit(message))


def even(x: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.bround(x, 0).cast("int")


def samples(ms, sr) -> Column:
    return even(_column(ms) * _column(sr) / 1000)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once for a row, not once for each sample."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def energy(a: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def decibels(ratio: Column) -> Column:
    """10 log10, minus infinity for 0."""
    return F.when(ratio == 0, F.expr("double('-Infinity')")).otherwise(F.log10(ratio) * 10)


def direct_index(rir: Column, distance: Column, sr, window_ms: float = 1.0) -> Column:
    """Sample (from 0) of the direct sound: the first largest magnitude near the time of flight."""
    expected, reach = even(distance / SPEED_OF_SOUND * _column(sr)), samples(window_ms, sr)
    start = F.greatest(F.lit(0), expected - reach)
    n = F.least(F.size(rir), expected + reach + 1) - start
    near = F.transform(F.slice(rir, start + 1, F.greatest(n, F.lit(0))), F.abs)
    place = F.array_position(near, F.array_max(near)).cast("int") - 1 + start
    return F.when(n <= 0, _error("the search window for the direct sound is outside the response")).otherwise(place)


def drr_db(rir: Column, direct: Column, sr, half_window_ms: float = 1.25) -> Column:
    """Direct-to-reverberant ratio; ``direct`` is the direct sound's sample."""
    half = samples(half_window_ms, sr)
    start = F.greatest(F.lit(0), direct - half)
    near = energy(F.slice(rir, start + 1, F.least(F.size(rir), direct + half + 1) - start))
    rest = F.greatest(energy(rir) - near, F.lit(0.0))
    return F.log10((near + EPS) / (rest + EPS)) * 10


def trim(rir: Column, direct: Column, sr, lead_ms: float = 1.0) -> Column:
    """The response from shortly before the direct sound."""
    return F.slice(rir, F.greatest(F.lit(0), direct - samples(lead_ms, sr)) + 1, F.size(rir))


def loop(a: Column, length: Column, offset_ms: Column, sr) -> Column:
    """``length`` samples of the endless repetition of ``a``, from an offset on."""
    offset = samples(offset_ms, sr)
    endless = F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda i: F.get(a, (offset + i) % F.size(a)))
    return F.when(F.size(a) == 0, _error("an empty clip can't be looped")).otherwise(F.slice(endless, F.lit(1), length))


def rms(a: Column) -> Column:
    return F.sqrt(energy(a) / F.size(a))


def normalized(a: Column, level: Column) -> Column:
    """``a`` over its ``level`` (:func:`rms`)."""
    return bound(level, lambda v: F.transform(a, lambda x: x / (v + EPS)))


def frame_length(sr, frame_ms: float = 25.0) -> Column:
    return F.floor(_column(sr) * frame_ms / 1000).cast("int")


def frame_powers(a: Column, sr, frame_ms: float = 25.0) -> Column:
    """Mean square of each frame; the last one may be shorter."""
    n = frame_length(sr, frame_ms)
    first = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), n)
    powers = F.transform(first, lambda i: energy(F.slice(a, i, n)) / F.size(F.slice(a, i, n)))
    return F.when(F.size(a) > 0, powers).otherwise(F.expr("cast(array() as array<double>)"))


def active_frames(powers: Column, threshold: float = 0.01) -> Column:
    """Frames whose power reaches a share of the largest one."""
    cutoff = (F.array_max(powers) + EPS) * threshold
    return bound(cutoff, lambda c: F.transform(powers, lambda p: p >= c))


def mask(a: Column, active: Column, sr, frame_ms: float = 25.0) -> Column:
    """Flags of frames as flags of samples."""
    n = frame_length(sr, frame_ms)
    return F.transform(a, lambda _, i: F.get(active, F.floor(i / n).cast("int")))


def power(a: Column, flags: Column) -> Column:
    """Mean square of the samples that are flagged."""
    chosen = F.filter(F.zip_with(a, flags, lambda x, m: F.when(m, x * x)), lambda x: x.isNotNull())
    n = F.size(F.filter(flags, lambda m: m))
    return F.when(n == 0, _error("the mask selects no sample")).otherwise(total(chosen) / n)


def snr_db(speech_power: Column, noise_power: Column) -> Column:
    return decibels(speech_power / (noise_power + EPS))


def noise_gain(snr: Column, target_db: Column) -> Column:
    """Factor on the noise that brings a ratio to the target."""
    return F.pow(F.lit(10.0), (snr - target_db) / 20)


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def guard_scale(largest: Column, limit: float = 0.99) -> Column:
    """Scale that keeps a mixture, and with it its parts, within the limit."""
    return F.when(largest > limit, F.lit(limit) / largest).otherwise(F.lit(1.0))


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def c50_db(rir: Column, direct: Column, sr) -> Column:
    """Early (50 ms) to late energy after the direct sound."""
    n = F.floor(_column(sr) * 0.05).cast("int")
    early, late = energy(F.slice(rir, direct + 1, n)), energy(F.slice(rir, direct + n + 1, F.size(rir)))
    return F.when((early <= 0) | (late <= 0), _nan()).otherwise(F.log10(early / late) * 10)


def sums_from(values: Column) -> Column:
    """Sum of each element and those behind it.  The array is copied at each step: for short ones."""
    # prefix sums by merging a pair (sum so far, sums) over the reversed array
    start = F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<double>)").alias("all"))
    return F.aggregate(F.reverse(values), start, lambda t, x: F.struct((t["s"] + x).alias("s"), F.array_append(t["all"], t["s"] + x).alias("all")), lambda t: F.reverse(t["all"]))


def decay_curve(rir: Column, direct: Column) -> Column:
    """Energy from each sample on, from the direct sound; for short responses."""
    return sums_from(F.transform(F.slice(rir, direct + 1, F.size(rir)), lambda x: x * x))


def _below(sums: Column, whole: Column, db: float) -> Column:
    """Place (from 1) of the first of ``sums`` that is ``db`` or less in dB of ``whole``; 0 if none is."""
    return F.array_position(F.transform(sums, lambda s: F.log10(F.greatest(s / whole, F.lit(1e-20))) * 10 <= db), True)


def t30_s(sums: Column, sr) -> Column:
    """Twice the time between the first fall to -5 dB and to -35 dB of a decay (energies of :func:`decay_curve`)."""

    def of(sums: Column, whole: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            return F.when((start == 0) | (end == 0), _nan()).otherwise(((end - start) * 2 / _column(sr)).cast("double"))

        return bound(_below(sums, whole, -5.0), lambda start: bound(_below(sums, whole, -35.0), lambda end: between(start, end)))

    return bound(sums, lambda s: bound(F.get(s, F.lit(0)), lambda whole: F.when((F.size(s) == 0) | (whole <= 0), _nan()).otherwise(of(s, whole))))


#: Samples of a block of :func:`t30_blocks`.
BLOCK = 128


def t30_blocks(rir: Column, direct: Column, sr) -> Column:
    """:func:`t30_s` of a long response, by sums of two levels: of blocks, and within the block where a level is crossed.

    Energies from a sample on never rise, so the first one below a level stands in the block before the first block that begins
    below it.  Every sample is read once and two blocks a second time; only arrays of the blocks' size or number are copied.
    """

    def crossing(tail: Column, ends: Column, whole: Column, db: float) -> Column:
        """Number of the first sample below ``db``, null if none is."""

        def inside(k: Column) -> Column:  # k: first block that begins below the level, from 1; none: behind the last
            first = (k - 2) * BLOCK
            rest = F.coalesce(F.get(ends, (k - 1).cast("int")), F.lit(0.0))
            own = F.transform(sums_from(F.transform(F.slice(tail, (first + 1).cast("int"), F.lit(BLOCK)), lambda x: x * x)), lambda s: s + rest)
            at = bound(_below(own, whole, db), lambda j: F.when(j > 0, first + j - 1).when(k <= F.size(ends), first + BLOCK))
            return F.when(k < 2, 0).otherwise(at)

        return bound(_below(ends, whole, db), lambda k: bound(F.when(k == 0, F.size(ends) + 1).otherwise(k), inside))

    def of(tail: Column, ends: Column) -> Column:
        def time(whole: Column) -> Column:
            start, end = crossing(tail, ends, whole, -5.0), crossing(tail, ends, whole, -35.0)
            return F.when(whole <= 0, _nan()).otherwise(F.coalesce(((end - start) * 2 / _column(sr)).cast("double"), _nan()))

        return bound(F.get(ends, F.lit(0)), time)

    def blocks(tail: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(tail) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda i: energy(F.slice(tail, i * BLOCK + 1, F.lit(BLOCK))))

    tail = F.slice(rir, direct + 1, F.size(rir))
    return bound(tail, lambda t: F.when(F.size(t) == 0, _nan()).otherwise(bound(sums_from(blocks(t)), lambda ends: of(t, ends))))


def t30_table(df: DataFrame, key: str, rir: str, direct: str, sr: int) -> DataFrame:
    """(key, t30) by running sums over exploded samples: the definition as a window; :func:`t30_blocks` gives the same without a row for each sample."""
    tail = df.select(key, F.posexplode(F.slice(rir, F.col(direct) + 1, F.size(rir))).alias("pos", "x"))
    left = Window.partitionBy(key).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = tail.withColumn("s", F.sum(F.col("x") * F.col("x")).over(left))
    whole = F.max("s").over(Window.partitionBy(key))
    fall = F.when(whole > 0, F.log10(F.greatest(F.try_divide(F.col("s"), whole), F.lit(1e-20))) * 10)
    ends = sums.withColumn("db", fall).groupBy(key).agg(*(F.min(F.when(F.col("db") <= level, F.col("pos"))).alias(name) for level, name in ((-5.0, "start"), (-35.0, "end"))))
    return df.select(key).join(ends, key, "left").select(key, F.coalesce(((F.col("end") - F.col("start")) * 2 / sr).cast("double"), _nan()).alias("t30"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def convolved(a: Column, b: Column) -> Column:
    """Full convolution by the definition; for short arrays (long ones: :mod:`.dsp`)."""
    n = F.size(a) + F.size(b) - 1

    def at(k: Column) -> Column:
        return F.aggregate(F.transform(a, lambda x, i: x * F.coalesce(F.when(k - i >= 0, F.get(b, k - i)), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def sound_item(a: Column) -> Column:
    """Whether a waveform is non-empty and finite throughout."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) > 0) & finite, F.lit(False))

