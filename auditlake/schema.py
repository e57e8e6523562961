"""Column sets, header aliases and rule tables of the study data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names and numbers that must equal the ones in users' files.
# ---------------------------------------------------------------------------

# Finding name in score exports -> field of the study table.
FINDINGS = {
    "Atelectasis": "atelectasis",
    "Calcification": "calcification",
    "Cardiomegaly": "cardiomegaly",
    "Consolidation": "consolidation",
    "Fibrosis": "fibrosis",
    "Mediastinal Widening": "mediastinal_widening",
    "Nodule": "nodule",
    "Pleural Effusion": "pleural_effusion",
    "Pneumoperitoneum": "pneumoperitoneum",
    "Pneumothorax": "pneumothorax",
    "Tuberculosis": "tuberculosis",
}

# Workplace code -> short site name; everything else is OTHER_SITE.
SITES = {
    "GLCR01": "GEY",
    "KALCR01": "KAL",
    "SEMCR01": "SEM",
    "TPYCR01": "TPY",
    "KHACR01": "KHA",
    "WDLCR01": "WDL",
    "HOUCR01": "HOU",
    "AMKCR01": "AMK",
    "YISCR01": "YIS",
    "SERCR01": "SER",
}
OTHER_SITE = "OTH"

# Workplace prefixes that fill half of a manual-review sample.
PRIORITY_PREFIXES = ("TPY", "HOU", "KHA", "AMK")

# Score thresholds: a site inherits every default it does not override.
THRESHOLDS = {
    "default": {
        "atelectasis": 10,
        "calcification": 10,
        "cardiomegaly": 10,
        "consolidation": 10,
        "fibrosis": 10,
        "mediastinal_widening": 10,
        "nodule": 15,
        "pleural_effusion": 10,
        "pneumoperitoneum": 10,
        "pneumothorax": 10,
        "tuberculosis": 999,
    },
    "YIS": {"nodule": 5},
}

# The one procedure code the image reader is meant for.
TARGET_PROCEDURE = 556
RECOMMENDED_SAMPLE_PCT = 2
LATE_SECONDS = 300
ROUTINE_PRIORITY = "5 AI_ROUTINE"
URGENT_PRIORITY = "4 URGENT"

# Header of the prediction column in files exchanged with other systems.
PREDICTION_HEADER = "lunit_binarised"

# Source header -> study field. Where two headers feed one field the later wins.
PLAIN_HEADERS = {
    "ACCESSION_NO": "accession_no",
    "StudyIDAnonymized": "study_id_anonymized",
    "StudyID": "study_id",
    "Patient Name": "patient_name",
    "Patient ID": "patient_id",
    "PATIENT_AGE": "patient_age",
    "PATIENT_GENDER": "patient_gender",
    "Instances": "instances",
    "Study Description": "study_description",
    "WORKPLACE": "workplace",
    "MEDICAL_LOCATION_NAME": "medical_location_name",
    "Institute": "medical_location_name",
    "Abnormal": "abnormal",
    **FINDINGS,
    "AI Report": "ai_report",
    "AI_PRIORITY": "ai_priority",
    "Feedback": "feedback",
    "Comments": "comments",
    "Status": "status",
    "TEXT_REPORT": "text_report",
    "gt_manual": "gt_manual",
    "manual_gt": "gt_manual",
    "gt_llm": "gt_llm",
    PREDICTION_HEADER: "prediction",
    "llm_grade": "llm_grade",
    "atelectasis_llm": "atelectasis_llm",
    "calcification_llm": "calcification_llm",
    "cardiomegaly_llm": "cardiomegaly_llm",
    "consolidation_llm": "consolidation_llm",
    "fibrosis_llm": "fibrosis_llm",
    "mediastinal_widening_llm": "mediastinal_widening_llm",
    "nodule_llm": "nodule_llm",
    "pleural_effusion_llm": "pleural_effusion_llm",
    "pneumoperitoneum_llm": "pneumoperitoneum_llm",
    "pneumothorax_llm": "pneumothorax_llm",
    "tb": "tb_llm",
    "tb_llm": "tb_llm",
}
TIMESTAMP_HEADERS = {
    "Upload Date": "upload_date",
    "Inference Date": "inference_date",
    "AI_FLAG_RECEIVED_DATE": "ai_flag_received_date",
    "PROCEDURE_START_DATE": "procedure_start_date",
    "PROCEDURE_END_DATE": "procedure_end_date",
}
DURATION_HEADERS = {
    "Time_End_to_End": "time_end_to_end_seconds",
    "Time to clinical_decision(mins)": "time_to_clinical_decision_seconds",
}
TURNAROUND_HEADER = "REPORT_TURN_AROUND_TIME"
IGNORED_HEADERS = ("Unnamed: 0", "", "Unnamed: 0.1")
EXPECTED_HEADERS = ("ACCESSION_NO", "WORKPLACE", "TEXT_REPORT", "gt_llm", PREDICTION_HEADER)

# Columns that decide what kind of export a file is.
SCORE_KEY_HEADERS = ("Accession Number", "ACCESSION_NO")
REPORT_REQUIRED = ("ACCESSION_NO", "TEXT_REPORT")
SCORE_REQUIRED = tuple(FINDINGS)

# Column order of a finished pipeline result; other columns follow.
RESULT_ORDER = (
    "StudyIDAnonymized", "StudyID", "Patient Name", "Patient ID", "Instances",
    "PATIENT_AGE", "PATIENT_GENDER", "Study Description", "Upload Date", "ACCESSION_NO",
    "Abnormal", *FINDINGS,
    "Feedback", "Comments", "Status", "Inference Date", "AI Report",
    "WORKPLACE", "PROCEDURE_START_DATE", "PROCEDURE_END_DATE", "AI_PRIORITY",
    "AI_FLAG_RECEIVED_DATE", "Time_End_to_End", "Time to clinical_decision(mins)",
    "TEXT_REPORT", "gt_manual", "gt_llm", PREDICTION_HEADER,
)
RESULT_DROPPED = ("PROCEDURE_CODE", "MEDICAL_LOCATION_NAME", "Age", "Gender", "Accession Number")
MERGE_DROPPED = ("MEDICAL_LOCATION_CODE", "PROCEDURE_NAME")

# Columns of the listing page; these are also the sortable ones.
LISTED_FIELDS = (
    "accession_no", "procedure_start_date", "created_at", "workplace", "gt_llm",
    "prediction", "gt_manual", "atelectasis", "calcification", "cardiomegaly",
    "consolidation", "fibrosis", "mediastinal_widening", "nodule", "pleural_effusion",
    "pneumoperitoneum", "pneumothorax",
)
FILTER_FIELDS = ("workplace", "gt_llm", "prediction", "gt_manual", "llm_grade", "ai_priority")
SEARCH_FIELDS = ("accession_no", "patient_name", "patient_id", "text_report", "workplace")
READONLY_FIELDS = ("accession_no", "created_at", "updated_at")

# Columns of the period export and of the two disagreement exports.
PERIOD_EXPORT = (
    "accession_no", "workplace", "procedure_start_date", "gt_llm", "prediction", "llm_grade",
    "abnormal", "atelectasis", "calcification", "cardiomegaly", "consolidation", "fibrosis",
    "mediastinal_widening", "nodule", "pleural_effusion", "pneumoperitoneum", "pneumothorax",
    "text_report",
)
DISAGREEMENT_EXPORT = (
    "accession_no", "workplace", "procedure_start_date", "gt_llm", "gt_manual", "prediction",
    "atelectasis", "calcification", "cardiomegaly", "consolidation", "fibrosis",
    "mediastinal_widening", "nodule", "pleural_effusion", "pneumoperitoneum", "pneumothorax",
    "text_report",
)
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------

FINDING_FIELDS = tuple(FINDINGS.values())
REPORT_FINDING_FIELDS = tuple(f for f in FINDING_FIELDS if f != "tuberculosis")
LLM_FINDING_FIELDS = tuple(f"{f}_llm" for f in REPORT_FINDING_FIELDS) + ("tb_llm",)
LABEL_FIELDS = ("gt_manual", "gt_llm", "prediction", "llm_grade") + LLM_FINDING_FIELDS
SITE_NAMES = tuple(sorted([*SITES.values(), OTHER_SITE]))

STUDY_SCHEMA = T.StructType(
    [T.StructField("accession_no", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("study_id_anonymized", "study_id", "patient_name", "patient_id")]
    + [T.StructField("patient_age", T.IntegerType()), T.StructField("patient_gender", T.StringType())]
    + [T.StructField("instances", T.IntegerType()), T.StructField("study_description", T.StringType())]
    + [T.StructField(c, T.TimestampType()) for c in ("upload_date", "inference_date")]
    + [T.StructField(c, T.StringType()) for c in ("workplace", "medical_location_name")]
    + [T.StructField(c, T.DoubleType()) for c in ("abnormal", *FINDING_FIELDS)]
    + [T.StructField(c, T.StringType()) for c in ("ai_report", "ai_priority")]
    + [T.StructField("ai_flag_received_date", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("feedback", "comments", "status")]
    + [T.StructField(c, T.TimestampType()) for c in ("procedure_start_date", "procedure_end_date")]
    + [T.StructField(c, T.DoubleType()) for c in ("time_end_to_end_seconds", "time_to_clinical_decision_seconds")]
    + [T.StructField("text_report", T.StringType())]
    + [T.StructField(c, T.ShortType()) for c in LABEL_FIELDS]
    + [T.StructField(c, T.TimestampType()) for c in ("created_at", "updated_at")]
    + [T.StructField("processing_batch_id", T.StringType())]
)
STUDY_TYPES = {f.name: f.dataType.simpleString() for f in STUDY_SCHEMA}

# Types of known export columns; a column missing here stays text.
EXPORT_TYPES = {
    "ACCESSION_NO": "bigint",
    "Accession Number": "bigint",
    "PATIENT_AGE": "bigint",
    "PROCEDURE_CODE": "bigint",
    "PROCEDURE_START_DATE": "timestamp",
    "PROCEDURE_END_DATE": "timestamp",
    "AI_FLAG_RECEIVED_DATE": "timestamp",
    TURNAROUND_HEADER: "double",
    "Abnormal": "float",
    **{name: "float" for name in FINDINGS},
    "Overall_binary": "tinyint",
    "llm_grade_binary": "tinyint",
    "ground truth": "tinyint",
}

# Result of the structured extraction step.
EXTRACTION_SCHEMA = (
    "findings_all array<struct<finding:string,location:string,system:string,"
    "temporal:string,uncertainty:string>>,"
    "devices_all array<struct<medical_device:string,placement:string>>,"
    "diagnoses_all array<struct<diagnosis:string,temporal:string>>"
)
