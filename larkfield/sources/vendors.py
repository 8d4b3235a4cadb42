"""Vendors behind tools: the synthetic scenario, and placeholders that say that they have no data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkfield.operators import series
from larkfield.operators.routing import chain, route
from larkfield.sources.errors import NotConfiguredError

# Fixed values of the demonstration scenario.
DEVICES = (
    ("PUMP-02", "灌溉泵", True, ""), ("VALVE-11", "滴灌阀门（A 组）", True, "E04"), ("FAN-03", "环控风机", False, "通信超时"), ("SENSOR-10", "土壤墒情探头（10cm）", True, ""),
)
INVENTORY = (
    ("人力", "", 2.0, "人"), ("机具", "3 号植保机", 1.0, "台"), ("机具", "滴灌阀门 A 组", 1.0, "组"), ("机具", "背负式喷雾器", 2.0, "台"),
    ("农资", "生物农药 X", 12.0, "L"), ("农资", "叶面肥 Y", 0.5, "L"), ("备件", "电磁阀线圈", 1.0, "个"),
)


def device_status(spark: SparkSession, site: str, as_of: str) -> DataFrame:
    """(site_id, device_id, kind, online, fault_code, as_of): nothing later than the as-of date is told."""
    return spark.createDataFrame([(site, *d, as_of) for d in DEVICES], "site_id string, device_id string, kind string, online boolean, fault_code string, as_of string")


def inventory(spark: SparkSession, site: str) -> DataFrame:
    return spark.createDataFrame([(site, *x) for x in INVENTORY], "site_id string, category string, item string, amount double, unit string")


def imagery(spark: SparkSession, site: str, as_of: str) -> DataFrame:
    return spark.createDataFrame([(site, as_of, "暗绿色水渍状不规则斑点", series.camera_ratio(site))], "site_id string, as_of string, finding string, leaf_area_percent int")


def placeholder(tool: str) -> Callable:
    """A vendor that isn't connected; a safety check has to fail rather than pass."""

    def run(*args, **kwargs):
        raise NotConfiguredError(f"{tool} has no data source")

    return run


REGISTRY: dict[str, dict[str, Callable]] = {
    "get_sensor_readings": {"synthetic": series.sensor_readings}, "get_weather_forecast": {"synthetic": series.weather}, "get_remote_sensing_index": {"synthetic": series.remote_sensing},
    "get_device_status": {"synthetic": device_status}, "get_resource_inventory": {"synthetic": inventory}, "get_camera_snapshot": {"synthetic": imagery},
    "check_safety_policy": {}, "dispatch_command": {}, "get_execution_status": {},
}
CATEGORY = {
    "get_sensor_readings": "sensors", "get_weather_forecast": "weather", "get_remote_sensing_index": "sensors", "get_device_status": "sensors", "get_camera_snapshot": "sensors",
    "get_resource_inventory": "ops", "check_safety_policy": "ops", "dispatch_command": "actuators", "get_execution_status": "actuators",
}
#: tools whose absence is told as no data; all others fail
OPTIONAL = ("get_camera_snapshot", "get_remote_sensing_index")


def call(tool: str, config: dict, *args, **kwargs):
    """One tool through its chain of vendors."""
    known = {"placeholder": placeholder(tool), **REGISTRY[tool]}
    return route(chain(tool, CATEGORY[tool], config["tools"], config["categories"]), known, *args, optional=tool in OPTIONAL, **kwargs)
