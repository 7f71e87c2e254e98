"""Closed vocabularies and special readings."""

# Canonical token and surface forms (fr / en / ar) of each vocabulary.
VOCABULARIES = {
    "bool": {"yes": ["oui", "o", "yes", "y", "نعم", "اجل", "✓", "+", "fait"], "no": ["non", "n", "no", "لا", "ابدا", "0"]},
    "test_result": {
        "negative": ["neg", "nég", "négatif", "negatif", "négative", "negative", "-", "سلبي", "سلبية", "(-)"],
        "positive": ["pos", "pos +", "positif", "positive", "+", "(+)", "إيجابي", "ايجابي", "إيجابية"],
        "not_done": ["non fait", "nf", "not done", "لم يتم", "لم تجر"],
    },
    "immunity": {"immune": ["immune", "immunisée", "immunisee", "imm", "مناعة", "محصنة", "منيعة"], "non_immune": ["non immune", "non immunisée", "not immune", "nonimmune", "غير محصنة", "غير منيعة"]},
    "normal_finding": {
        "normal": ["ras", "normal", "normale", "normales", "normaux", "n", "aucun", "aucune", "néant", "neant", "none", "nil", "nad", "عادي", "عادية", "طبيعي", "طبيعية", "لا شيء", "سليم"],
        "abnormal": ["anormal", "anormale", "abnormal", "pathologique", "غير طبيعي", "غير عادي"],
    },
    "conjunctiva": {"normal": ["normales", "normale", "normal", "colorées", "colorees", "ras", "عادية", "طبيعية"], "pale": ["pâles", "pales", "pâle", "pale", "décolorées", "decolorees", "شاحبة"]},
    "cervix": {"closed": ["fermé", "ferme", "closed", "مغلق"], "open": ["ouvert", "open", "مفتوح"], "modified": ["modifié", "modifie", "effacé", "efface", "ramolli", "changed", "متغير"]},
    "presentation": {"cephalic": ["céphalique", "cephalique", "cephalic", "sommet", "رأسي", "رأسية"], "breech": ["siège", "siege", "breech", "مقعدي", "مقعدية"], "transverse": ["transverse", "transversale", "épaule", "shoulder", "عرضي"]},
    "sex": {"F": ["f", "féminin", "feminin", "fille", "female", "girl", "أنثى", "انثى", "بنت"], "M": ["m", "masculin", "garçon", "garcon", "male", "boy", "ذكر", "ولد"]},
    "delivery_mode": {
        "vaginal": ["voie basse", "vb", "vaginal", "vaginale", "naturelle", "normal", "ولادة طبيعية", "طبيعية", "طبيعي"],
        "instrumental": ["instrumentale", "voie basse instrumentale", "forceps", "ventouse", "instrumental"],
        "cesarean": ["césarienne", "cesarienne", "césar", "cs", "cesarean", "c-section", "caesarean", "قيصرية", "عملية قيصرية"],
    },
    "education": {
        "none": ["aucun", "aucune", "analphabète", "analphabete", "néant", "none", "illiterate", "أمية", "لا شيء"],
        "primary": ["primaire", "primary", "ابتدائي"],
        "secondary": ["collège", "college", "lycée", "lycee", "secondaire", "secondary", "high school", "middle school", "إعدادي", "اعدادي", "ثانوي"],
        "higher": ["supérieur", "superieur", "université", "universite", "universitaire", "higher", "university", "جامعي", "عالي"],
    },
    "pap_smear": {"normal": ["normal", "normale", "ras", "négatif", "negatif", "negative", "عادي", "طبيعي"], "abnormal": ["anormal", "abnormal", "positif", "غير طبيعي"], "not_done": ["non fait", "not done", "nf", "jamais", "never", "لم يتم"]},
    "history": {"none": ["ras", "aucun", "aucune", "néant", "neant", "rien", "none", "nil", "nothing", "no", "لا شيء", "لاشيء", "لا يوجد", "عادي"]},
}
# Readings that stand for a status.
DASHES = ["-", "—", "–", "−", "_", "/", "--", "—-", "ـ", "x", "×"]
UNKNOWN_TOKENS = ["?", "??", "nsp", "inconnu", "inconnue", "unknown", "nc", "ne sait pas", "غير معروف", "لا أعرف", "مجهول"]
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
