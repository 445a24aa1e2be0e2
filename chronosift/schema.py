"""Canonical tables."""

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

#: What the miner reads.
INTERVALS = _fields(("client_id", _S), ("state", _S), ("start_time", _D), ("end_time", _D))
INTERVALS_WITH_ORIGIN = _fields(("client_id", _S), ("dataset", _S), ("participant_id", _S), ("state", _S), ("start_time", _D), ("end_time", _D))
#: Samples of all signals, in long form.
SIGNALS = _fields(("participant", _S), ("signal", _S), ("ts", _D), ("value", _D))
#: Level bins of each variable.
THRESHOLDS = _fields(("var", _S), ("low_cut", _D), ("high_cut", _D))
TRIPLES = _fields(("s", _S), ("p", _S), ("o", _S))
WIDE_SIGNALS = _fields(*((n, _D) for n in ("daqtime", "ecg", "bvp", "gsr", "rsp", "skt", "emg_zygo", "emg_coru", "emg_trap")))
JOYSTICK = _fields(*((n, _D) for n in ("jstime", "valence_raw", "arousal_raw")))
ANNOTATIONS = _fields(("seconds", _D), ("arousal", _D), ("valence", _D))
DEMOGRAPHICS = _fields(("dataset", _S), ("participant_id", _S), ("client_id", _S), ("gender", _S), ("age", _D), ("age_group", _S), ("binary_age_group", _S))
