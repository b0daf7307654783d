"""``key = value`` configuration: typed, range-checked options; unknown keys are reported and skipped."""

from __future__ import annotations

import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class Option:
    default: object
    low: float | None = None
    high: float | None = None


# fixed values: options of the finder and their defaults
OPTIONS: dict[str, Option] = {
    "inputFile": Option(""), "outputFile": Option("output"), "tileSizeX": Option(1000, 1), "tileSizeY": Option(1000, 1), "tileStepSizeX": Option(1.0, 0.0, 1.0), "tileStepSizeY": Option(1.0, 0.0, 1.0), "useTiles": Option(False),
    "boxSizeX": Option(20.0, 0.0), "boxSizeY": Option(20.0, 0.0), "gridSizeX": Option(0.2, 0.0, 1.0), "gridSizeY": Option(0.2, 0.0, 1.0), "bkgEstimator": Option(2, 1, 4), "useLocalBkg": Option(True), "use2ndPassInLocalBkg": Option(True),
    "seedThr": Option(5.0, 0.0), "mergeThr": Option(2.6, 0.0), "minNPix": Option(5, 1), "compactSourceSearchNIters": Option(1, 1), "seedThrStep": Option(0.5, 0.0), "searchNegativeExcess": Option(False),
    "fitSources": Option(False), "fitMaxNComponents": Option(5, 1), "wtScaleSearchMin": Option(3, 1), "wtScaleSearchMax": Option(3, 1), "saliencyThrFactor": Option(2.8, 0.0),
}


def parse(text: str) -> dict[str, object]:
    """Option values of a configuration text, defaults filled in; a value of the wrong type or out of range is an error."""
    out = {k: o.default for k, o in OPTIONS.items()}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        key, sep, value = (p.strip() for p in line.partition("="))
        if not sep:
            raise ValueError(f"not an option: {line!r}")
        option = OPTIONS.get(key)
        if option is None:
            warnings.warn(f"unknown option {key!r}", stacklevel=2)
            continue
        kind = type(option.default)
        if kind is bool:
            if value.lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"{key}: {value!r} is no truth value")
            got: object = value.lower() in ("true", "1")
        else:
            got = kind(value)
        if kind in (int, float) and ((option.low is not None and got < option.low) or (option.high is not None and got > option.high)):
            raise ValueError(f"{key}: {got} is out of range")
        out[key] = got
    return out
