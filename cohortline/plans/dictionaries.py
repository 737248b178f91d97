"""Fixed values of the clinical registry: columns, codes, spellings, patterns and thresholds."""

# --- fixed values: file columns and their names here ------------------------------------------
RENAME = {
    "Hosp_ID": "hosp_id",
    "Pat_Name": "pat_name",
    "E_Date": "e_date",
    "Iv_Date": "iv_date",
    "Death Date": "death_date",
    "Date_diagnosis": "dx_date",
    "Year_of_birth": "birth_year",
    "Encounter_Type": "encounter_type",
    "Survival": "outcome",
    "Serum_creatinine_mmol/l": "creatinine_raw",
    "HgB_g/dl": "hgb",
    "SerumAlbumin_g/l": "albumin",
    "SerumCalcium_unmol/l": "calcium",
    "Mcomponent_g/l": "m_component",
    "chief_complaint": "complaint",
    "Pain_site": "pain_site",
    "Signs_Symptoms": "signs",
    "Bleeding_Site": "bleeding_site",
    "Swelling_Site": "swelling_site",
    "Ecog_index": "ecog_index",
    "StartTreatment_regimen": "regimen_start",
    "ContinueTreatment_Regimen": "regimen_cont",
    "Chemo_Regimen": "regimen_chemo",
    "StartTreatment_Cycle": "cycle_start",
    "ContinueTreatment_Cycle": "cycle_cont",
    "Chemo_Cycle": "cycle_chemo",
    "ManagementPlan_Notes": "notes",
    "Remission_plan": "remission_plan",
    "Remission_date": "remission_date",
    "OnRemission": "on_remission",
}

# --- fixed values: columns dropped before the analysis ----------------------------------------
DROPPED = [
    "StartTreatment", "ContinueTreatment", "ChemoReinitiated", "StartTreatment_Supportivemed",
    "ContinueTreatment_SupportiveMed", "Chemo_SupportiveMed", "Occupation", "patID", "Visit_Type",
    "Vitals", "BMA", "BSA", "Diagnosis", "MM_Subtype", "Plasmacytoma_Subtype", "XRay", "CTScan",
    "MRI", "Ultrasound", "Spep", "Spep_date", "Upep", "Upep_date", "BMA_date", "SFLC", "SFLC_date",
    "LiverFunction_test", "LFT_date", "CBC", "CBC_date", "RenalFunction_date",
    "RenalFunctionAlbumin", "LabTest_Ordered", "OtherLabTests", "ImagingTestsOrdered",
    "OtherImagingTests", "NextVisit_date", "SurvivalStatus", "DeceasedDate", "CompletedBy",
]

# --- fixed values: cohort, thresholds, gaps ---------------------------------------------------
COHORT = ("2020-01-01", "2022-12-31")
CREATININE_CUT = 177
HGB_CUT = 10
CALCIUM_CUT = 2.75
CREATININE_GAP = 7
M_COMPONENT_GAP = 14
REPORT_MONTHS = 40.1
CENSORED = ["Alive", "LTFU"]
OUTCOMES = {"deceased": "Deceased", "DECEASED": "Deceased"}

# --- fixed values: codes, applied in this order -----------------------------------------------
COMPLAINT_CODES = [
    ("14", "None"),
    ("13", "Others"),
    ("12", "Swelling"),
    ("11", "Bleeding"),
    ("10", "Paralysis"),
    ("9", "Vomiting"),
    ("8", "Nausea"),
    ("7", "Numbness"),
    ("6", "Weight Loss"),
    ("5", "Decreased urine output"),
    ("4", "Frequent Infections"),
    ("3", "Fatigue"),
    ("2", "Diziness"),
    ("1", "Bone Pain"),
]
PAIN_CODES = [("5", "None"), ("4", "Upper Limb"), ("3", "Lower Limb"), ("2", "Back"), ("1", "Chest")]
SIGN_CODES = [("5", "None"), ("4", "Others"), ("3", "Fever"), ("2", "Bone Tenderness"), ("1", "Pallor")]

# --- fixed values: keyword flags, without regard to case --------------------------------------
COMPLAINT_FLAGS = {
    "bone_pain": "bone pain",
    "fatigue": "fatigue|fatique",
    "frequent_infections": "frequent infections",
    "decreased_urine_output": "decreased urine output",
    "weight_loss": "weight loss",
    "numbness": "numbness",
    "nausea": "nausea",
    "vomiting": "vomiting|vommiting",
    "paralysis": "paralysis",
    "bleeding": "bleeding",
    "swelling": "swelling",
    "others_complaint": "others|other",
    "diziness": "diziness|dizziness",
}
PAIN_FLAGS = {
    "back": "back pain|back",
    "chest": "chest|chest pain",
    "lower_limb": "lower limb|lower limp",
    "upper_limb": "upper limb|upper limp",
    # The same pattern as upper_limb: that is how the flag is specified.
    "no_pain_site": "upper limb|upper limp",
}
PAIN_FLAGS_INTENT = {**PAIN_FLAGS, "no_pain_site": "none"}
SIGN_FLAGS = {
    "pallor": "pallor",
    "bone_tenderness": "bone tenderness",
    "fever": "fever",
    "others_sign": "others|other",
    "no_symptom": "none",
}

# --- fixed values: spellings of sites ---------------------------------------------------------
BLEEDING_SITES = {"NOSE": "Nose", "NOSE.": "Nose", "MOUTH": "Mouth", "GUMS": "Gums"}
SWELLING_SITES = {
    "Bilateral swelling": "Bilateral Swelling",
    "billateral": "Bilateral Swelling",
    "bilateral": "Bilateral Swelling",
    "BILATERAL LL": "Bilateral Swelling",
    "BILLATERAL": "Bilateral Swelling",
    "bilateral lower limb swelling": "Bilateral Swelling",
    "BILATERAL LOWER LIMBS": "Bilateral Swelling",
    "lower limb": "Lower Limb",
    "lower limbs": "Lower Limb",
    "LOWER LIMB": "Lower Limb",
    "LL": "Lower Limb",
    "lower limb sweolling": "Lower Limb",
    "left lower limb": "Lower Limb",
    "abdomen": "Abdominal",
    "ABDOMINAL": "Abdominal",
    "abdominal": "Abdominal",
    "BACK": "Back",
    "back": "Back",
    "CHEST RT SIDE": "Chest area",
    "chest wall": "Chest area",
    "EYE": "Eye",
    "eye": "Eye",
    "face": "Face",
    "FACE": "Face",
}

# --- fixed values: performance index ----------------------------------------------------------
ECOG = {
    0: "Normal",
    1: "Symptomatic but ambulatory",
    2: "Bedridden <50%",
    3: "Bedridden >50%",
    4: "bedridden 100%",
}

# --- fixed values: treatment ------------------------------------------------------------------
REGIMENS = {
    "1": "VTD",
    "15": "Others",
    "2": "TD",
    "3": "VRD",
    "4": "VCD",
    "5": "VD",
    "6": "VMD",
    "7": "RD",
    "2;7": "TD",
    "VTD, VTD": "VTD",
}
# Patterns in management notes; the first that occurs gives the treatment.
NOTE_RULES = [
    ("to VTD", "VTD"),
    ("restart on VTD", "VTD"),
    ("re initiated on VD", "VD"),
    ("ON MAINTENANCE Cychlophosphamide", "C"),
    ("CT THALIDOMIDE.", "T"),
    ("CT LENALIDOMIDE.", "R"),
    ("CONTINUE MAITENANCE LENALIDOMIDE", "R"),
    ("CONTINUE BORTEZOMIB", "V"),
    ("To continue with zolendronic Acid", "Zolendronic acid"),
    ("CAME FOR INJ ZOLENDRONIC", "Zolendronic acid"),
    ("on monthly zolendronic", "Zolendronic acid"),
    ("on lenalidomide", "R"),
    ("on maintenance thalidex", "TD"),
    ("strat bortezomib as maintenance", "V"),
    ("CONTINUE WITH BORTEZOMIB", "V"),
    ("continue bortezomib maintenance.", "V"),
    ("on maintenance lenalidomide", "R"),
    ("on maintenance therapy of lenalidomide", "R"),
    ("CT MAINTENANCE WITH LENALIDOMIDE.", "R"),
    ("maintenance of lenalidomide", "R"),
    ("on maintenance RD", "RD"),
    ("to lenalidomide", "R"),
    ("on TD", "TD"),
    ("of thalidomide", "T"),
    ("with lenalidomide", "R"),
    ("On thalidomide", "T"),
    ("of lenalidomide", "R"),
    ("of thalidomide", "T"),
    ("CONTINUE THALIDOMIDE MAINTENANCE", "T"),
    ("with thalidomide", "T"),
    ("maintenance thalidomide", "T"),
    ("on VTD", "VTD"),
    ("CONTINUE THALIDOMIDE MAINTENANCE", "T"),
    ("TO VRD", "VRD"),
    ("STARTED ON RADIOTHERAPY", "Radiotherapy"),
    ("DIED BEFORE TREATMENT.", "Died before treatment"),
    ("TO RD", "RD"),
    ("TO START TREATMENT,VTD", "VTD"),
    ("ON MAINTENANCE OF RD", "RD"),
    ("with lenalidomide maintenance", "R"),
    ("TO RD", "RD"),
]

# --- fixed values: remission ------------------------------------------------------------------
REMISSION_CODES = {
    "1": "Start Drug Holiday",
    "2": "Continue Drug Holiday",
    "3": "Start Maintenance Therapy",
    "4": "Continue Maintenance",
}
REMISSION_PLANS = {
    "Continue Drug Holiday": "Drug Holiday",
    "Continue Maintenance": "On Maintenance Therapy",
    "Continue Maintenance Therapy": "On Maintenance Therapy",
    "CONTINUE WITHMAINTENANCE": "On Maintenance Therapy",
    "Start Drug Holiday": "Drug Holiday",
    "Start Maintanance Therapy": "On Maintenance Therapy",
    "Start Maintenance Therapy": "On Maintenance Therapy",
}
STOP_PLAN = "stop all medications"
MAINTENANCE = "On Maintenance Therapy"
# What in the notes means maintenance, without regard to case.
MAINTENANCE_NOTES = (
    "maintenance|start remission|with remission|thalidomide maintanance|start maintanance|"
    "continue maintanance|on maintanance|maitainance|maintance|mainance|maitenance"
)
MAINTENANCE_NOTES_INTENT = MAINTENANCE_NOTES + "|on miantenance|in remission"

# --- fixed values: front of the result table --------------------------------------------------
FRONT_COLUMNS = [
    "iv_date", "hosp_id", "dx_date", "e_date", "treatment", "regimen_start", "regimen_cont",
    "regimen_chemo", "treatment", "ecog_index", "ecog_label", "m_component", "spep",
    "creatinine_raw", "creatinine", "hgb", "anemia", "albumin", "calcium", "corrected_calcium",
    "cycle_start", "cycle_cont", "cycle_chemo", "cycle",
]
