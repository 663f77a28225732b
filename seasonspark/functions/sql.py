"""SQL functions of the same names: inlined by Catalyst like built-in expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_MOD = "(({x}) - {p} * floor(({x}) / {p}))"
_SIGMA = "(1 / (1 + exp(-({x}))))"

#: name -> (parameters, expression)
FUNCTIONS = {
    "floored_mod": ("x DOUBLE, p DOUBLE", _MOD.format(x="x", p="p")),
    "logistic": ("x DOUBLE", _SIGMA.format(x="x")),
    "double_logistic": (
        "t DOUBLE, xs DOUBLE, ss DOUBLE, xa DOUBLE, sa DOUBLE, bias DOUBLE, scale DOUBLE",
        f"bias + scale * ({_SIGMA.format(x='try_divide(t - xs, ss)')} - {_SIGMA.format(x='try_divide(t - xa, sa)')})",
    ),
    "cyclic_gaussian": (
        "t DOUBLE, a DOUBLE, mu DOUBLE, sigma DOUBLE, c DOUBLE",
        f"c + a * exp(-0.5 * pow(try_divide({_MOD.format(x='t - mu + 182.5', p='365D')} - 182.5, sigma), 2))",
    ),
    "tanh_sine": ("t DOUBLE, phase DOUBLE, bias DOUBLE, scale DOUBLE, k DOUBLE", "bias + scale * tanh(k * sin(2 * pi() * (t - phase) / 365)) / if(k = 0, 1D, tanh(k))"),
    "greenup_rate": ("t DOUBLE, xs DOUBLE, ss DOUBLE", "{s} * (1 - {s})".format(s=_SIGMA.format(x="try_divide(t - xs, ss)"))),
    "centred_sawtooth": ("t DOUBLE, p DOUBLE, zero DOUBLE, slope DOUBLE", f"({_MOD.format(x='t - zero - p / 2', p='p')} - p / 2) * slope"),
    "grid_row": ("lat DOUBLE", "cast((90 - lat) / 0.05D as int)"),
    "grid_col": ("lon DOUBLE", "cast((lon + 180) / 0.05D as int)"),
    "slug": ("s STRING", "translate(s, '+- /.', 'pm_-p')"),
}


def register(spark: SparkSession) -> None:
    """Create the functions for the session."""
    for name, (parameters, body) in FUNCTIONS.items():
        kind = "STRING" if name == "slug" else "INT" if name.startswith("grid_") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
