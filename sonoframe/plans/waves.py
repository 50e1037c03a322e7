"""Measures of series taken as short waveforms at 8 kHz."""

from __future__ import annotations

from sonoframe.functions import signals
from sonoframe.plans.cases import case
from sonoframe.sources.bindings import spectra

case("wave_measures", lambda spark, d: signals.measures(spectra(spark, d), 8000.0))
