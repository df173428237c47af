"""A fluent interface to the analysis of a batch of series, and a recorder of what was asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import RqaConfig
from .operators import embed, features, generate, information, lines, measures, parameters, recurrence, series, windows
from .sources import series as sources


class Rqa:
    """Lazily worked out stages over a table of series: delay, dimension, radius, plot, measures.
    Each stage is one DataFrame over all series, made when first asked for."""

    def __init__(self, table: DataFrame, dims: int = 1, normalise: bool = True, config: RqaConfig | None = None, recorder: Recorder | None = None, **given):
        self.config, self.dims, self.given = config or RqaConfig(), dims, given
        self.recorder = recorder or Recorder()
        self.series = series.zscore(table, dims, 0.0 if self.config.legacy else 1e-10) if normalise else table
        self._made: dict[str, DataFrame] = {}
        self.recorder.record("load", f"rqa = Rqa(series, dims={dims}, normalise={normalise})")

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
            self.recorder.record(name, f"rqa.{name}()")
        return self._made[name]

    def delay(self) -> DataFrame:
        if self.config.tau_method == "polynomial":
            return self._once("delay", lambda: generate.delay_polynomial(self.series, self.dims, self.config.legacy))
        if self.config.legacy:
            return self._once("delay", lambda: information.delay_legacy(self.series, self.dims))
        return self._once("delay", lambda: information.delay(self.series, self.dims, self.config.mi_method))

    def parameters(self) -> DataFrame:
        """(sid, tau, m, eps)."""
        return self._once("parameters", lambda: features.parameters_of(self.series, self.config, self.dims, **self.given).persist())

    def embedded(self) -> DataFrame:
        return self._once("embedded", lambda: embed.delay_embed_by(self.series, self.parameters().where("m > 0")))

    def plot(self) -> DataFrame:
        """(sid, i, j): recurrent pairs i > j."""
        return self._once("plot", lambda: recurrence.recurrence_pairs(self.embedded(), self.parameters()))

    def _runs(self) -> DataFrame:
        return lines.plot_runs(recurrence.recurrent_places(self.embedded(), self.parameters(), tile=recurrence.tile_for(self.series)))

    def rate(self) -> DataFrame:
        return self._once("rate", lambda: recurrence.recurrence_rate(self.plot(), recurrence.sizes(self.embedded())))

    def measures(self, lmin: int | None = None) -> DataFrame:
        lmin = lmin or self.config.lmin
        if self.config.legacy:
            return self._once(f"measures_{lmin}", lambda: measures.legacy_of(lines.runs_histogram(self._runs()), ("sid",), lmin))
        return self._once(f"measures_{lmin}", lambda: measures.measures_of(lines.runs_histogram(self._runs()), lmin=lmin))

    def windowed(self, window: int, step: int = 1, lmin: int | None = None) -> DataFrame:
        windows.check(window, step)
        self.recorder.record("windowed", f"rqa.windowed({window}, {step})")
        of = measures.legacy_of if self.config.legacy else measures.measures_of
        return of(lines.windowed_runs(self._runs(), window, step), ("sid", "window_start"), lmin or self.config.lmin, window)

    def summary(self, window: int, step: int = 1, stats: tuple[str, ...] = ("mean", "median", "mode")) -> DataFrame:
        return windows.summarise(self.windowed(window, step), stats, measures.LEGACY_MEASURES if self.config.legacy else measures.MEASURES)

    def group_radius(self) -> DataFrame:
        return parameters.group_radius_joint(self.embedded(), self.config)

    def save(self, path: str) -> None:
        sources.save_results({"series": self.series, "parameters": self.parameters(), "plot": self.plot(), "measures": self.measures()}, self.config.__dict__, path)

    def reset(self) -> None:
        """Forgets all stages."""
        if "parameters" in self._made:
            self._made["parameters"].unpersist()
        self._made.clear()


def batch(source: DataFrame, output: str, dims: int = 1, group: bool = False, config: RqaConfig | None = None, **given) -> None:
    """Analyses all series of source and writes measures, parameters and errors below output. Series
    that are too short or have missing values go to the errors and are left out."""
    bad = sources.errors(source)
    good = source.join(bad.select("sid"), "sid", "left_anti")
    run = Rqa(good, dims, config=config, group=group, **given)
    run.measures().join(run.parameters(), "sid").write.mode("overwrite").parquet(f"{output}/measures")
    run.plot().write.mode("overwrite").parquet(f"{output}/plots")
    bad.write.mode("overwrite").parquet(f"{output}/errors")
    run.reset()


class Recorder:
    """Keeps the calls of a session as a script."""

    def __init__(self):
        self._blocks: list[tuple[str, str]] = []

    def record(self, title: str, code: str) -> None:
        self._blocks.append((title, code.strip()))

    def clear(self) -> None:
        self._blocks.clear()

    @property
    def n_blocks(self) -> int:
        return len(self._blocks)

    def script(self) -> str:
        head = "from pyspark.sql import SparkSession\nfrom echoplane.pipeline import Rqa\n\nspark = SparkSession.builder.getOrCreate()"
        return "\n\n".join([head, *(f"# {t}\n{c}" for t, c in self._blocks)]) + "\n"
