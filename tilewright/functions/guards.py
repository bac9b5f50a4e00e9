"""Guards of JSON payloads: whether a VARIANT has the fields, of the kinds, that a shape asks for.

A shape is a dict of field names and kinds: text, number, flag, none (null is there), a set of kinds,
or a list of one shape or kind for an array of such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = {"text": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT"), "flag": ("BOOLEAN",), "none": ("VOID",)}

#: Fields of the payloads that jobs, results and engines send.
JOB_EVENTS = {
    "preparing": {"jobId": "text"}, "device": {"device": "text", "tile": "number"}, "processing": {"done": "number", "total": "number"}, "completing": {}, "completed": {}, "failed": {"code": "text", "message": "text"}, "cancelled": {},
}
RESULT = {
    "imageId": "text", "filePath": "text", "width": "number", "height": "number", "sourceWidth": "number", "sourceHeight": "number", "outputWidth": "number", "outputHeight": "number", "label": "text", "engine": "text", "dataUrl": {"text", "none"},
}
ENGINE = {
    "device": "text", "models": [{"id": "text", "state": "text"}], "ready": "flag", "scales": ["number"], "modes": [{"key": "text", "available": "flag"}], "filters": [{"key": "text", "label": "text", "available": "flag"}], "modelsDirDisplay": "text",
}


def _type(shape: dict | list | set | str) -> str:
    """The type that takes all values of a shape out of a VARIANT at once; what is not there, or no record or array where one has to be, is null."""
    if isinstance(shape, dict):
        return f"struct<{', '.join(f'`{name}`: {_type(inner)}' for name, inner in shape.items())}>"
    return f"array<{_type(shape[0])}>" if isinstance(shape, list) else "variant"


def _holds(x: Column, shape: dict | list | set | str) -> Column:
    """Whether values taken out by `_type` have their kinds; never null."""
    if isinstance(shape, dict):
        return reduce(Column.__and__, [_holds(x[name], inner) for name, inner in shape.items()], x.isNotNull())
    if isinstance(shape, list):
        return x.isNotNull() & F.coalesce(F.forall(x, lambda e: _holds(e, shape[0])), F.lit(False))
    kind = F.coalesce(F.schema_of_variant(x), F.lit(""))
    starts = [k for s in (sorted(shape) if isinstance(shape, set) else [shape]) for k in _KINDS[s]]
    return reduce(Column.__or__, [kind.startswith(k) for k in starts], F.lit(False))


def _taken(v: Column, shape: dict | list | set | str) -> Column:
    return F.try_variant_get(v, "$", _type(shape)) if isinstance(shape, (dict, list)) else v


def fits(v: Column, shape: dict | list | set | str) -> Column:
    """True or false; a null VARIANT fits nothing. All fields are taken out together, so v is gone through once."""
    return _holds(_taken(v, shape), shape)


def is_job_event(v: Column) -> Column:
    """The phase names the fields that have to be there."""
    every = {"phase": "text"} | {name: kind for shape in JOB_EVENTS.values() for name, kind in shape.items()}
    said = _taken(v, every)
    phase = F.when(_holds(said["phase"], "text"), F.try_variant_get(said["phase"], "$", "string"))
    out = F.lit(False)
    for name, shape in JOB_EVENTS.items():
        out = F.when(phase == name, _holds(said, shape)).otherwise(out)
    return out


def is_result(v: Column) -> Column:
    return fits(v, RESULT)


def is_engine_status(v: Column) -> Column:
    return fits(v, ENGINE)
