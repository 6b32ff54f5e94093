"""Wind turbine signals: raw name, display name, stored statistics and tags."""

from __future__ import annotations

# Turbine signals. Raw stem, display stem, statistics, tags of the average.
TURBINE_SIGNALS = (
    ("Gen_RPM", "Generator RPM", ("Max", "Min", "Avg", "Std"), ("system_state",)),
    ("Gen_Bear_Temp", "Generator Bearing Temperature", ("Avg",), ("system_state",)),
    ("Gen_Bear2_Temp", "Generator Bearing 2 Temperature", ("Avg",), ("system_state",)),
    ("Gen_Phase1_Temp", "Generator Phase 1 Temperature", ("Avg",), ("system_state",)),
    ("Gen_Phase2_Temp", "Generator Phase 2 Temperature", ("Avg",), ("system_state",)),
    ("Gen_Phase3_Temp", "Generator Phase 3 Temperature", ("Avg",), ("system_state",)),
    ("Gen_SlipRing_Temp", "Generator Slip Ring Temperature", ("Avg",), ("system_state",)),
    ("Rtr_RPM", "Rotor RPM", ("Max", "Min", "Avg", "Std"), ("system_state",)),
    ("Amb_WindSpeed", "Ambient Wind Speed", ("Max", "Min", "Avg", "Std"), ("forecast_available",)),
    ("Amb_WindSpeed_Est", "Estimated Ambient Wind Speed", ("Avg",), ("power_proxy",)),
    ("Amb_WindDir_Relative", "Relative Wind Direction", ("Avg",), ("system_state", "circular")),
    ("Amb_WindDir_Abs", "Absolute Wind Direction", ("Avg",), ("forecast_available", "circular")),
    ("Amb_Temp", "Ambient Temperature 2", ("Avg",), ("forecast_available",)),
    ("Blds_PitchAngle", "Blade Pitch Angle", ("Min", "Max", "Avg", "Std"), ("system_state",)),
    ("Grd_Prod_Pwr", "Grid Produced Power", ("Avg", "Max", "Min", "Std"), ("target",)),
    ("Grd_Prod_ReactPwr", "Grid Reactive Power", ("Avg", "Max", "Min", "Std"), ("power_proxy",)),
    ("Grd_Prod_PsblePwr", "Grid Possible Power", ("Avg", "Max", "Min", "Std"), ("power_proxy",)),
    ("Grd_Prod_PsbleInd", "Grid Possible Inductive Power", ("Avg", "Max", "Min", "Std"), ("power_proxy",)),
    ("Grd_Prod_PsbleCap", "Grid Possible Capacitive Power", ("Avg", "Max", "Min", "Std"), ("power_proxy",)),
    ("Grd_Prod_CosPhi", "Grid CosPhi", ("Avg",), ("power_proxy",)),
    ("Grd_Prod_Freq", "Grid Frequency", ("Avg",), ("system_state",)),
    ("Grd_Prod_VoltPhse1", "Grid Voltage Phase 1", ("Avg",), ("power_proxy",)),
    ("Grd_Prod_VoltPhse2", "Grid Voltage Phase 2", ("Avg",), ("power_proxy",)),
    ("Grd_Prod_VoltPhse3", "Grid Voltage Phase 3", ("Avg",), ("power_proxy",)),
    ("Grd_Prod_CurPhse1", "Grid Current Phase 1", ("Avg",), ("power_proxy",)),
    ("Grd_Prod_CurPhse2", "Grid Current Phase 2", ("Avg",), ("power_proxy",)),
    ("Grd_Prod_CurPhse3", "Grid Current Phase 3", ("Avg",), ("power_proxy",)),
    ("Grd_InverterPhase1_Temp", "Grid Inverter Phase 1 Temperature", ("Avg",), ("system_state",)),
    ("Grd_RtrInvPhase1_Temp", "Grid Rotor Inverter Phase 1 Temperature", ("Avg",), ("system_state",)),
    ("Grd_RtrInvPhase2_Temp", "Grid Rotor Inverter Phase 2 Temperature", ("Avg",), ("system_state",)),
    ("Grd_RtrInvPhase3_Temp", "Grid Rotor Inverter Phase 3 Temperature", ("Avg",), ("system_state",)),
    ("Grd_Busbar_Temp", "Grid Busbar Temperature", ("Avg",), ("system_state",)),
    ("HVTrafo_Phase1_Temp", "High Voltage Transformer Phase 1 Temperature", ("Avg",), ("system_state",)),
    ("HVTrafo_Phase2_Temp", "High Voltage Transformer Phase 2 Temperature", ("Avg",), ("system_state",)),
    ("HVTrafo_Phase3_Temp", "High Voltage Transformer Phase 3 Temperature", ("Avg",), ("system_state",)),
    ("Cont_Top_Temp", "Control Cabinet Top Temperature", ("Avg",), ("system_state",)),
    ("Cont_Hub_Temp", "Control Hub Temperature", ("Avg",), ("system_state",)),
    ("Cont_VCP_Temp", "VCP Temperature", ("Avg",), ("system_state",)),
    ("Cont_VCP_ChokcoilTemp", "VCP Choke Coil Temperature", ("Avg",), ("system_state",)),
    ("Cont_VCP_WtrTemp", "VCP Water Temperature", ("Avg",), ("system_state",)),
    ("Hyd_Oil_Temp", "Hydraulic Oil Temperature", ("Avg",), ("system_state",)),
    ("Gear_Oil_Temp", "Gear Oil Temperature", ("Avg",), ("system_state",)),
    ("Gear_Bear_Temp", "Gear Bearing Temperature", ("Avg",), ("system_state",)),
    ("Nac_Temp", "Nacelle Temperature", ("Avg",), ("system_state",)),
    ("Nac_Direction", "Nacelle Direction", ("Avg",), ("system_state", "circular")),
    ("Spin_Temp", "Spinner Temperature", ("Avg",), ("system_state",)),
)

# Production counters, raw name and display name; all are power proxies.
PRODUCTION_SIGNALS = (
    ("Prod_LatestAvg_ActPwrGen0", "Active Power Generator 0"),
    ("Prod_LatestAvg_ActPwrGen1", "Active Power Generator 1"),
    ("Prod_LatestAvg_ActPwrGen2", "Active Power Generator 2"),
    ("Prod_LatestAvg_TotActPwr", "Total Active Power"),
    ("Prod_LatestAvg_ReactPwrGen0", "Reactive Power Generator 0"),
    ("Prod_LatestAvg_ReactPwrGen1", "Reactive Power Generator 1"),
    ("Prod_LatestAvg_ReactPwrGen2", "Reactive Power Generator 2"),
    ("Prod_LatestAvg_TotReactPwr", "Total Reactive Power"),
)

# Weather mast signals (statistic comes first in the raw name); all forecast_available.
MAST_SIGNALS = (
    ("Windspeed1", "Wind Speed 1", ("Min", "Max", "Avg", "Var")),
    ("Windspeed2", "Wind Speed 2", ("Min", "Max", "Avg", "Var")),
    ("AmbientTemp", "Ambient Temperature", ("Min", "Max", "Avg")),
    ("Pressure", "Atmospheric Pressure", ("Min", "Max", "Avg")),
    ("Humidity", "Humidity", ("Min", "Max", "Avg")),
    ("Precipitation", "Precipitation", ("Min", "Max", "Avg")),
    ("Raindetection", "Rain Detection", ("Avg", "Min", "Max")),
)

# Mast instrument settings, raw name, display name, tag (empty: none).
INSTRUMENT_SIGNALS = (
    ("Anemometer1_Freq", "Anemometer 1 Frequency", "forecast_available"),
    ("Anemometer1_Offset", "Anemometer 1 Offset", "forecast_available"),
    ("Anemometer1_CorrGain", "Anemometer 1 Correction Gain", "forecast_available"),
    ("Anemometer1_CorrOffset", "Anemometer 1 Correction Offset", "forecast_available"),
    ("Anemometer1_Avg_Freq", "Anemometer 1 Frequency_Avg", ""),
    ("Anemometer2_Freq", "Anemometer 2 Frequency", "forecast_available"),
    ("Anemometer2_Offset", "Anemometer 2 Offset", "forecast_available"),
    ("Anemometer2_CorrGain", "Anemometer 2 Correction Gain", "forecast_available"),
    ("Anemometer2_CorrOffset", "Anemometer 2 Correction Offset", "forecast_available"),
    ("Anemometer2_Avg_Freq", "Anemometer 2 Frequency_Avg", ""),
    ("Pressure_Avg_Freq", "Pressure Sensor Frequency_Avg", "system_state"),
    ("DistanceAirPress", "Distance to Air Pressure Sensor", "forecast_available"),
    ("AirRessureSensorZeroOffset", "Air Pressure Sensor Zero Offset", "forecast_available"),
)

# Keys, labels and derived columns, raw name, display name, tags.
OTHER_COLUMNS = (
    ("Turbine_ID", "Turbine ID", ("meta",)),
    ("Timestamp", "Timestamp", ("meta",)),
    ("DayOfYear", "DayOfYear", ("forecast_available", "circular")),
    ("MinuteOfDay", "MinuteOfDay", ("forecast_available", "circular")),
    ("Turbulence Intensity", "Turbulence Intensity", ("forecast_available",)),
    ("Turbulence Intensity 1", "Turbulence Intensity 1", ("forecast_available",)),
    ("Turbulence Intensity 2", "Turbulence Intensity 2", ("forecast_available",)),
    ("Wind Shear", "Wind Shear", ("forecast_available",)),
    ("Component", "Component", ("meta",)),
    ("Timestamp_failure", "Failure Timestamp", ("meta",)),
    ("Remarks", "Remarks", ("meta",)),
    ("rul", "RUL", ("meta",)),
    ("impending_failure", "Impending Failure", ("meta",)),
)

# Value ranges of the circular features.
CYCLIC_RANGES = {
    "Relative Wind Direction": (-180, 180),
    "Absolute Wind Direction": (0, 360),
    "MinuteOfDay": (0, 24 * 60 - 1),
    "DayOfYear": (1, 366),
    "Nacelle Direction": (0, 360),
}

# Mast columns that are not used, and the anemometer heights in metres.
UNUSED_MAST_COLUMNS = ("Min_Winddirection2", "Max_Winddirection2", "Avg_Winddirection2", "Var_Winddirection2")
ANEMOMETER_HEIGHTS = {"Wind Speed 1": 80.0, "Wind Speed 2": 77.0}

# Summer time as UTC instants [start, end).
SUMMER_TIME = (
    ("2016-03-27 03:00:00", "2016-10-30 02:00:00"),
    ("2017-03-26 03:00:00", "2017-10-29 02:00:00"),
)


def rename_map() -> dict[str, str]:
    """Raw column name to display name; averaged signals keep a statistic suffix."""
    names = {raw: shown for raw, shown, _ in OTHER_COLUMNS}
    for raw, shown, stats, _ in TURBINE_SIGNALS:
        names.update({f"{raw}_{s}": f"{shown}_{s}" for s in stats})
    names.update({raw: f"{shown}_Avg" for raw, shown in PRODUCTION_SIGNALS})
    for raw, shown, stats in MAST_SIGNALS:
        names.update({f"{s}_{raw}": f"{shown}_{s}" for s in stats})
    names.update({raw: shown for raw, shown, _ in INSTRUMENT_SIGNALS})
    return names


def feature_tags() -> dict[str, frozenset]:
    """Display name (suffix ``_Avg`` removed) to tags; circular features bring their sin/cos pair."""
    plain = {shown: tags for _, shown, tags in OTHER_COLUMNS}
    plain.update({shown: tags for _, shown, _, tags in TURBINE_SIGNALS})
    plain.update({shown: ["power_proxy"] for _, shown in PRODUCTION_SIGNALS})
    plain.update({shown: ["forecast_available"] for _, shown, _ in MAST_SIGNALS})
    plain.update({shown.removesuffix("_Avg"): [tag] for _, shown, tag in INSTRUMENT_SIGNALS if tag})
    return with_encodings(plain)


def with_encodings(plain: dict[str, list[str]]) -> dict[str, frozenset]:
    """Add ``<name>_sin`` and ``<name>_cos`` behind every circular feature."""
    tags: dict[str, frozenset] = {}
    for name, own in plain.items():
        tags[name] = frozenset(own)
        if "circular" in own:
            encoded = frozenset(own) - {"circular"} | {"cyclical_encoding"}
            tags[f"{name}_sin"] = encoded
            tags[f"{name}_cos"] = encoded
    return tags
