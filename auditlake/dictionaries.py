"""Priority dictionaries: term -> priority 1..5. The position of a term is also its code."""

from __future__ import annotations

# The terms, their order and their priorities must match the graders' own lists.
FINDING_TERMS = {
    "normal": 1,
    "suboptimal study": 2,
    "chronic changes": 2,
    "calcified densities": 3,
    "calcified granuloma": 3,
    "calcified adenopathy": 3,
    "calcified pleural thickening": 3,
    "calcified pleural plaques": 3,
    "calcified heart valve": 2,
    "calcified fibroadenoma": 3,
    "aortic mural calcification": 2,
    "granuloma": 3,
    "end on vessel": 3,
    "adenopathy": 3,
    "nodule": 3,
    "pseudonodule": 2,
    "nipple shadow": 1,
    "abscess": 4,
    "cyst": 2,
    "cavitation": 4,
    "fibrotic band": 3,
    "volume loss": 3,
    "hypoexpansion": 3,
    "bullas": 3,
    "pneumothorax": 3,
    "hydropneumothorax": 5,
    "pneumoperitoneum": 5,
    "pneumomediastinum": 5,
    "subcutaneous emphysema": 5,
    "hyperinflated lung": 3,
    "flattened diaphragm": 3,
    "lung vascular paucity": 3,
    "air trapping": 3,
    "bronchiectasis": 3,
    "interstitial opacities": 4,
    "ground glass pattern": 4,
    "reticular interstitial pattern": 4,
    "reticulonodular interstitial pattern": 4,
    "reticulonodular": 4,
    "nodular opacities": 4,
    "miliary opacities": 4,
    "alveolar pattern": 4,
    "consolidation": 4,
    "airspace opacities": 4,
    "patchy opacities": 4,
    "scarring": 2,
    "lung opacities not otherwise specified": 4,
    "bronchovascular markings": 4,
    "air fluid level": 4,
    "increased density": 3,
    "atelectasis": 3,
    "mediastinal shift": 3,
    "azygos lobe": 2,
    "fissure thickening": 3,
    "pleural thickening": 3,
    "pleural plaques": 3,
    "pleural effusion": 4,
    "loculated pleural effusion": 4,
    "loculated fissural effusion": 4,
    "lung collapse": 4,
    "empyema": 4,
    "hemothorax": 4,
    "pleural mass": 4,
    "costophrenic angle blunting": 4,
    "vascular redistribution": 3,
    "pulmonary artery enlargement": 4,
    "hilar congestion": 4,
    "cardiomegaly": 3,
    "kerley lines": 4,
    "dextrocardia": 2,
    "right sided aortic arch": 2,
    "aortic atheromatosis": 2,
    "aortic elongation": 2,
    "aortic aneurysm": 4,
    "aortic unfolding": 2,
    "mediastinal enlargement": 4,
    "superior mediastinal enlargement": 4,
    "goiter": 3,
    "supra aortic elongation": 3,
    "mediastinal mass": 4,
    "tracheal shift": 3,
    "mass": 4,
    "breast mass": 4,
    "pulmonary mass": 4,
    "soft tissue mass": 4,
    "esophageal dilatation": 4,
    "azygoesophageal recess shift": 4,
    "pericardial effusion": 4,
    "mediastinal lipomatosis": 2,
    "thoracic cage deformation": 2,
    "scoliosis": 2,
    "kyphosis": 2,
    "pectus excavatum": 3,
    "pectus carinatum": 3,
    "cervical rib": 2,
    "vertebral degenerative changes": 2,
    "vertebral compression": 3,
    "vertebral anterior compression": 3,
    "lytic bony lesion": 4,
    "sclerotic bony lesion": 4,
    "costochondral junction": 2,
    "sternoclavicular joint hypertrophy": 3,
    "axial hyperostosis": 3,
    "osteopenia": 2,
    "osteoporosis": 2,
    "non axial articular degenerative changes": 2,
    "subacromial space narrowing": 2,
    "fracture": 4,
    "clavicular fracture": 4,
    "humeral fracture": 4,
    "vertebral fracture": 4,
    "rib fracture": 4,
    "callus rib fracture": 3,
    "gynecomastia": 2,
    "hiatus hernia": 3,
    "Chilaiditi sign": 2,
    "hemidiaphragm elevation": 2,
    "diaphragmatic eventration": 2,
    "artificial heart valve": 3,
    "surgery": 2,
    "metal": 2,
    "orthopedic implants": 2,
    "sternotomy": 2,
    "suture material": 2,
    "bone cement": 2,
    "prosthesis": 2,
    "humeral prosthesis": 2,
    "mammary prosthesis": 2,
    "endoprosthesis": 2,
    "aortic endoprosthesis": 2,
    "surgery breast": 2,
    "mastectomy": 2,
    "surgery neck": 2,
    "surgery lung": 2,
    "surgery heart": 2,
    "surgery humeral": 2,
    "abnormal foreign body": 3,
    "external foreign body": 3,
    "pulmonary tuberculosis": 4,
}
DEVICE_TERMS = {
    "tracheostomy tube": 3,
    "endotracheal tube": 4,
    "NG tube": 3,
    "feeding tube": 3,
    "chest drain tube": 4,
    "chest tube": 5,
    "ventriculoperitoneal drain tube": 3,
    "gastrostomy tube": 3,
    "nephrostomy tube": 3,
    "double j stent": 4,
    "catheter": 4,
    "other drainage catheter": 4,
    "central venous catheter": 4,
    "central venous catheter via subclavian vein": 4,
    "PICC": 4,
    "Port-a-cath": 3,
    "dialysis catheter": 3,
    "electrical device": 3,
    "dual chamber device": 3,
    "single chamber device": 3,
    "pacemaker": 3,
    "dai": 3,
    "IABP": 4,
    "Swan-Ganz catheter": 4,
}
DIAGNOSIS_TERMS = {
    "P1 finding": 5,
    "Tuberculosis": 4,
    "Lung cancer": 4,
    "Pneumonia": 4,
    "Lung collapse": 4,
    "Mastectomy": 2,
}

TEMPORAL_CODES = ("new", "better", "worse", "stable", "not mentioned")
CERTAINTY_CODES = ("certain", "uncertain", "not mentioned")
PLACEMENT_CODES = ("satisfactory", "suboptimal", "malpositioned", "not mentioned")
