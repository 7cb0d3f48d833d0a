"""Fixed values of the footprint model: parameters, sentinel codes, labels, code lists."""

# --- fixed values: scope of a run ------------------------------------------------------
SEED = 2025
N_SAMPLES = 1000
LAG_YEARS = 3

# --- fixed values: carbon fractions and stoichiometry ----------------------------------
CARBON_BIOMASS = 0.47
CARBON_LITTER = 0.37
CARBON_DEAD_MATTER = 0.5
CO2_PER_C = 44.0 / 12.0
KG_PER_T = 1000.0
SEASON_FRACTION = 0.5
CLEARED_DRY_MATTER = 10.0

# --- fixed values: mass balance --------------------------------------------------------
BEAN_PER_EQ = 1.031
MEAL_MASS = 0.81
OIL_MASS = 0.19

# --- fixed values: hydrological and land reference volumes -----------------------------
GLOBAL_FRESHWATER = 9.90e12
GLOBAL_SEAWATER = 6.56e16
GLOBAL_SOIL = 6.40e12
DAYS_PER_YEAR = 365.25

# --- fixed values: sentinels -----------------------------------------------------------
UNKNOWN_ORIGIN = [9999999]
UNKNOWN_EXPORT_PORT = [99]
DOMESTIC_PORT = 27
UNKNOWN_IMPORT_PORT = [998, 999]
DOMESTIC_PORT_NAME = "PROCESSED DOMESTICALLY"
DOMESTIC_PORT_UNIT = 9999998
DOMESTIC_IMPORT_PORT = 15
DOMESTIC_COUNTRY = "BRAZIL"
DOMESTIC_REGION = "Domestic"
DOMESTIC_ACRONYM = "BRDOM"
UNKNOWN_NAME = "UNKNOWN"
POOLED_REGION = "EU"

# --- fixed values: provenance labels ---------------------------------------------------
ORIGIN_LABELS = [
    "non_imputed",
    "trader_imputed",
    "import_country_imputed",
    "import_region_imputed",
    "economic_region_imputed",
]
EXPORT_PORT_LABELS = ["Non_imputed", "Trader_imputed", "Origin_imputed", "Import_country_imputed"]
IMPORT_PORT_LABELS = ["Non_imputed", "Trader_imputed", "Port_export_imputed"]
LAND_USE_LABELS = ["Non_imputed", "Origin_node-Year-Company imputed", "Origin_node-Year imputed"]
YIELD_LABELS = [
    "consulted",
    "imputed based on municipality data",
    "imputed based on state data in the concern year",
    "imputed based on state data",
]
TRADE_LABELS = [
    "original data",
    "Imputed based on average of origin-destination link",
    "Imputed based on average of destination country in the corresponding year",
    "Imputed based on average of origin municipality in the corresponding year",
    "Imputed based on average of destination country",
]
CARBON_LABELS = [
    "estimated",
    "imputed based on average of the municipality",
    "imputed based on average of the state in each year",
    "imputed based on average of the state",
    "imputed based on average of the region each year",
]
LAND_LABELS = [
    "estimated",
    "imputed base on average dato of the municipality",
    "imputed base on average of the state in each year",
    "imputed base on average of the state",
    "imputed base on average of the region in each year",
]

# --- fixed values: code lists ----------------------------------------------------------
STATE_DATA_CODES = [11, 15, 21, 29, 31, 35, 41, 43, 50, 51, 52]
TRADE_CODES = {1201: "soybeans_a", 1208: "meal_from_beans_a", 1507: "oil_a", 2304: "cake_a"}
CRUSHING_PRODUCTS = {"1. Grão": "soybeans_a", "2. Farelo": "cake_a"}
DOMESTIC_ENTRIES = [
    "2.3.5. - Consumo interno",
    "2.2.5. - Consumo interno",
    "2.1.4. - Sementes/Outros",
]
CROP_CLASS = 39
BURNABLE_CLASSES = [3, 4, 12]
LAND_USE_CLASSES = [39, 20, 40, 41, 62]
FOREST_AREA_TYPE = "Natural_forest"
HABITAT_IDS = [2, 3, 4]
FIELD_TYPES = ["fertiliser", "soil_correctors", "machinery"]

# --- fixed values: emission to substance and carbon pool -------------------------------
EMISSION_SUBSTANCES = [
    ("CO2e_soc", "CO2", "iSOC"),
    ("CO2e_bmb", "CO2", "ibmb"),
    ("CH4e", "CH4", "ibmb"),
    ("N2Oe", "N2O", "ibmb"),
    ("NOxe", "NOx", "ibmb"),
]
FIELD_SUBSTANCES = ["N2O", "NOx", "NH3", "CO2", "CO2_b", "CO", "SO2", "NMVOC", "PM2.5"]
COMBUSTION_SUBSTANCES = ["NOx", "CO2", "CO2_b", "SO2", "NMVOC", "PM2.5"]

# --- fixed values: literal processing flows per kg of meal -----------------------------
MEAL_FLOWS = [
    ("crushing-Electricity", "Electricity", "Electricity_m", 0.025),
    ("crushing-Natural_Gas_High_Pressure", "Natural_Gas_High_Pressure",
     "Natural_Gas_High_Pressure_m", 0.095 / (10 * 4.184)),
    ("crushing-Tap_water", "Tap_water", "Tap_water_m", 0.056),
]
MEAL_FLOW_SOURCE = "Ecoinvent 3.11"

# --- fixed values: impact stages -------------------------------------------------------
FARM_ACTIVITIES = {
    "fertiliser": "Fertilisation",
    "pesticide": "Pestcontrol",
    "soil_correctors": "Amendment",
    "sowing": "Sowing",
    "machinery": "Machinery",
}
PROCESS_STAGES = {
    "Hexane": "i_p_Hexane_pd",
    "Tap_water": "i_p_Tapwater_pd",
    "Diesel": "i_p_diesel_pd",
    "Natural_Gas_High_Pressure": "i_p_Naturalgas_pd",
    "Hardwood_Chips_From_Forest": "i_p_heat_from_wood_pd",
    "Natural_Gas_High_Pressure_m": "i_p_Naturalgas_m_pd",
    "Tap_water_m": "i_p_Tapwater_m_pd",
}
ELECTRICITY_STAGES = {
    "Electricity": "i_p_electricity_pd",
    "Electricity_m": "i_p_electricity_m_pd",
}
LAND_STAGES = ["i_land_occupation", "i_land_transformation", "i_luclu_above_biomass", "i_luclu_soc"]
FARM_STAGES = [f"i_f_{name}_{kind}" for name in
               ["Amendment", "Fertilisation", "Machinery", "Pestcontrol", "Sowing"]
               for kind in ["of", "pd"]]
PROC_STAGES = ["i_p_diesel_pd", "i_p_heat_from_wood_pd", "i_p_Hexane_pd", "i_p_Naturalgas_pd",
               "i_p_Tapwater_pd", "i_p_electricity_pd", "i_p_fuel_combustion_of"]
MEAL_STAGES = ["i_p_Naturalgas_m_pd", "i_p_Tapwater_m_pd", "i_p_electricity_m_pd"]
TRANSPORT_STAGES = ["i_domestic_transport", "i_international_transport"]
ALL_STAGES = LAND_STAGES + FARM_STAGES + PROC_STAGES + MEAL_STAGES + TRANSPORT_STAGES
REGIONS = ["Mid_western", "Northern", "North_eastern", "South_eastern", "Southern"]
GRID_MIX = "Electricity_Low_Voltage_voltage"
LORRY = "Transport_Freight_Lorry_32_EURO5"
SHIP = "Transport_Freight_Sea"
IMPACT_APPROACH = "All_effects_100yr"
LAND_DAMAGE = "Terrestrial ecosystems"
LAND_CATEGORY = "Land stress, TE, average"
