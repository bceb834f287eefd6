"""Tables of the engine."""

from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _BOOL, _TEXT, _TIME = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.TimestampNTZType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ASSETS = _table(
    asset_id=_LONG, kind=_INT, pixel_width=_INT, pixel_height=_INT, creation_ts=_TIME, modification_ts=_TIME,
    duration=_DOUBLE, is_favorite=_BOOL, burst_id=_TEXT, is_edited=_BOOL, is_hdr=_BOOL, byte_size=_LONG,
)
#: rgb: top to bottom, left to right, three channels a pixel.
PIXELS = _table(asset_id=_LONG, edge=_INT, rgb=T.BinaryType())
FINGERPRINTS = _table(
    asset_id=_LONG, dhash=_LONG, histogram=T.ArrayType(_INT), shape=T.ArrayType(_INT), shape_norm=_LONG,
    sharpness=_DOUBLE, exposure=_DOUBLE, mean_luma=_DOUBLE, keyframes=T.ArrayType(_LONG), stamp=_DOUBLE,
)
#: near: neighbours as (asset, score, stamp of the neighbour when it was measured); null: never searched for.
POINTS = _table(
    asset_id=_LONG, shape=T.ArrayType(_INT), shape_norm=_LONG, stamp=_DOUBLE,
    near=T.ArrayType(_table(a=_LONG, s=_DOUBLE, t=_DOUBLE)), near_stamp=_DOUBLE, near_version=_INT,
)
#: Lengths of the arrays of a fingerprint; a stored row with others is damaged.
PRINT_SIZES = {"histogram": 64, "shape": 480}
