"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the reference
pipeline's outputs for results to match: the class dimension, risk weights,
thresholds and the report labels (the reference reports in Russian). They
are stated plainly, in natural order, and used by both the Spark code and
the DuckDB oracle.
"""

# ---- FIXED VALUES: class dimension (id, name, RGB) -------------------------
CLASS_INFO = [
    (0, "Void", (0, 0, 0)),
    (1, "Normal", (59, 130, 246)),
    (2, "Marine growth", (134, 239, 172)),
    (6, "Paint peel", (252, 165, 165)),
    (9, "Corrosion", (196, 181, 253)),
]
VISIBLE_EXCLUDED_IDS = (0,)          # not drawn / not counted as visible
SIGN_EXCLUDED_IDS = (0, 1)           # not a defect sign
NORMAL_CLASS_ID = 1                  # dominant class of a two-head result without defects
FOREGROUND_THRESHOLD = 0.5           # of the one-channel foreground head
RISK_WEIGHTS = {2: 0.48, 6: 0.72, 9: 1.0}
DEFAULT_RISK_WEIGHT = 0.25
RISK_CAP = 0.98
COVERAGE_BONUS_STEP, COVERAGE_BONUS_CAP = 0.02, 0.18
CORROSION_BONUS_FACTOR, CORROSION_BONUS_CAP = 0.9, 0.22
# class 8 carries a bonus in the formula but is not in the class list
DEFECT8_BONUS_FACTOR, DEFECT8_BONUS_CAP = 0.8, 0.16

# ---- FIXED VALUES: quality and de-duplication defaults ---------------------
MIN_BRIGHTNESS = 12.0
MAX_BRIGHTNESS = 250.0
MIN_LAPLACIAN = 18.0
HAMMING_THRESHOLD = 1
BRIGHTNESS_CENTER = 118.0
LAPLACIAN_WEIGHT = 0.72
FALLBACK_FRAMES = 36
TARGET_FRAMES = 64
COVERAGE_BUCKETS = 24
FRAMES_PER_BUCKET = 3
MIN_INDEX_GAP = 6
BUCKET_MIN_DISTANCE = 8
GLOBAL_MIN_DISTANCE = 6
STORY_FRAMES = 6
PHOTO_BATCH_WINDOW_SEC = 20

# ---- FIXED VALUES: report labels -------------------------------------------
CLASS_TRANSLATIONS = {
    "Normal": "Норма",
    "Ship hull": "Норма",
    "Marine growth": "Обрастание",
    "Paint peel": "Отслоение краски",
    "Corrosion": "Коррозия",
    "Void": "Фон",
}
ALLOWED_CLASS_NAMES = ("Normal", "Ship hull", "Marine growth", "Paint peel", "Corrosion", "Void")
CLASS_COLOR_MAP = {
    "Normal": "#3b82f6",
    "Marine growth": "#86efac",
    "Paint peel": "#fca5a5",
    "Corrosion": "#c4b5fd",
    "Void": "#000000",
}
FALLBACK_CLASSES = [(1, "Normal", "#3b82f6"), (2, "Marine growth", "#86efac"),
                    (6, "Paint peel", "#fca5a5"), (9, "Corrosion", "#c4b5fd")]
NON_DEFECT_NAMES = ("Void", "Normal", "Ship hull")

# risk band: (low, medium, high)
BAND_LABELS = ("Низкий", "Средний", "Высокий")
PIPELINE_BAND_CUTS = (0.45, 0.7)     # score >= .7 high, >= .45 medium
DASHBOARD_BAND_CUTS = (0.35, 0.7)    # score < .35 low, < .7 medium
# urgency and state: (low, medium, high), cuts .45 / .7
URGENCY_LABELS = ("Плановое наблюдение", "В ближайший цикл", "Неотложно")
STATE_LABELS = ("Стабильное", "Требует контроля", "Критическое")
STATE_CODES = {"Стабильное": 1, "Требует контроля": 2, "Критическое": 3}
STATE_DEFAULT_CODE = 1
NO_ISSUE_LABEL = "Не выявлен"
ISSUE_CODES = {"Не выявлен": 0, "Обрастание": 1, "Коррозия": 2, "Отслоение краски": 3, "Норма": 4}
ISSUE_DEFAULT_CODE = 0
FALLBACK_RISK_WEIGHTS = {"Corrosion": 1.0, "Marine growth": 0.54, "Paint peel": 0.72,
                         "Normal": 0.02, "Ship hull": 0.02}
FALLBACK_RISK_DEFAULT = 0.2

PHOTO_BATCH_NAME = "photo-batch"     # source name of a photo run without one

# stage names: extraction, preprocessing, inference, export, other
STAGE_NAMES = ("Извлечение кадров", "Предобработка", "Инференс", "Запись результатов", "Прочие этапы")
OTHER_STAGE_MIN = 0.05
FRAME_LABEL_PREFIX = "Кадр"
TIME_NOT_GIVEN = "Время не указано"
TIME_SUFFIX = " сек"
NO_SIGN_LABEL = "Без выраженного признака"
DEFAULT_RECOMMENDATION = "Дополнительных мер по итогам анализа не требуется."

# defect comments by share >= 25, share >= 10, frames >= 10, else
DEFECT_COMMENTS = (
    "Выраженный признак, требует внимания",
    "Заметный признак, нужен контроль",
    "Локальный, но повторяющийся признак",
    "Единичные или слабые проявления",
)

# recommendations, live preset: risk high / medium / low, corrosion, peel,
# growth, filler; thresholds in percent of visible pixels
RECOMMENDATIONS_LIVE = {
    "high": "Необходимо провести повторный осмотр участка в приоритетном порядке и подготовить его к ремонтным работам.",
    "medium": "Участок рекомендуется включить в ближайший повторный осмотр и уточнить состояние проблемных зон.",
    "low": "Допускается сохранить плановый режим наблюдения без срочного вмешательства.",
    "corrosion": "Зоны с признаками коррозии рекомендуется проверить дополнительно и оценить необходимость локальной очистки.",
    "peel": "Участки с повреждением покрытия рекомендуется повторно осмотреть и включить в перечень локальных восстановительных работ.",
    "growth": "Участки с выраженным обрастанием рекомендуется включить в план очистки поверхности.",
    "filler": "При следующем осмотре рекомендуется повторно проверить зоны, где признаки встречались чаще всего.",
}
RECOMMENDATION_CUTS_LIVE = {"corrosion": 10.0, "peel": 8.0, "growth": 12.0}
# the earlier (shadowed) preset, offered as "strict"
RECOMMENDATIONS_STRICT = {
    "high": "Риск по участку высокий. Требуется повторный осмотр в приоритетном порядке и подготовка к ремонтным работам.",
    "medium": "Риск по участку средний. Рекомендуется включить участок в ближайший повторный осмотр.",
    "low": "Риск по участку низкий. Достаточно сохранить плановый режим наблюдения.",
    "corrosion": "Следует проверить зоны с признаками коррозии и оценить необходимость локальной очистки.",
    "peel": "Выявленные зоны с отслоением краски рекомендуется подтвердить при повторном визуальном контроле.",
    "growth": "Участки с выраженным обрастанием рекомендуется включить в план очистки.",
    "coverage": "При необходимости можно выполнить повторный осмотр с более плотной съемкой проблемной зоны.",
    "filler": "При следующем осмотре рекомендуется повторно проверить зоны, где признак встречается чаще всего.",
}
RECOMMENDATION_CUTS_STRICT = {"corrosion": 18.0, "peel": 12.0, "growth": 15.0, "coverage": 0.2}

# ---- FIXED VALUES: imputation of missing run counts ------------------------
# (factor, floor) per step: quality_ok from extracted, dedup from quality_ok,
# processed from dedup, segmented from processed
VIDEO_IMPUTE = ((0.78, 24), (0.86, 18), (0.92, 12), (0.95, 8))
VIDEO_INFERENCE_SHARE = 0.31
PHOTO_INFERENCE_SHARE = 0.34

# ---- FIXED VALUES: scaling estimates ---------------------------------------
VIDEO_OVERHEAD = (0.25, 0.14)        # max(floor, fraction * total)
PHOTO_OVERHEAD = (0.12, 0.12)
CURVE_SCALES = (1, 2, 3, 4)
PARALLEL_FACTOR = 1.72
PARALLEL_LABELS = ("1 видео", "2 видео параллельно")

# ---- FIXED VALUES: image constants -----------------------------------------
GRAY_WEIGHTS = (0.299, 0.587, 0.114)
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)
OVERLAY_ALPHA = 0.45
ACTIVE_SCORE_THRESHOLD = 0.35
TWO_HEAD_THRESHOLD = 0.5
DEFECT_MIN_RATIO = 1e-4
EXTRA_SIGN_MIN_RATIO = 0.01

PREDICTION_MODES = ("multiclass_segmentation", "multiclass_mthinet_segmentation",
                    "binary_segmentation_with_classification")

# ---- FIXED VALUES: hull hotspots (id, label, sensor key, position) --------
HOTSPOTS = [
    ("keel", "Киль", "Keel", (-4.8, -1.0, 0.0)),
    ("propeller", "Гребной винт", "Propeller", (-4.0, -2.0, 17.0)),
    ("bow-thruster", "Носовое подруливающее устройство", "Bow Thruster", (-1.5, -1.0, -14.5)),
    ("engine", "Кормовой участок корпуса", "Engine", (-4.5, -1.0, 12.0)),
]
HOTSPOT_DESCRIPTIONS = {
    "Носовое подруливающее устройство": "Зона подвержена коррозии из-за постоянного контакта с водой и электрохимических процессов.",
    "Кормовой участок корпуса": "Участок кормы в зоне движительного комплекса. Здесь часто фиксируются обрастание, износ покрытия и локальные очаги коррозии.",
    "Гребной винт": "Эта область уязвима к гальванической коррозии и кавитационным повреждениям.",
    "Киль": "Коррозия развивается из-за длительного контакта с морской водой и механических нагрузок.",
}
HOTSPOT_DEFAULT_DESCRIPTION = "Связанные снимки hotspot."
SENSOR_MISSING = "Н/Д"
HOTSPOT_PHOTO_PREFIX = "/generated/hotspot-photos/"
# photo file name matchers per hotspot (case-insensitive); hotspots without
# a matcher share the remaining photos in even chunks
HOTSPOT_MATCHERS = {
    "bow-thruster": r"(?i)^ruli(?: \(\d+\))?\.jpg$",
    "propeller": r"(?i)^propeller(?: \(\d+\))?\.jpg$",
    "engine": r"(?i)^stern_hull_\d+\.jpg$",
}
# static lists used when a matcher finds nothing
HOTSPOT_FALLBACK_FILES = {
    "bow-thruster": ["ruli (1).jpg", "ruli (2).jpg", "ruli (3).jpg", "ruli (4).jpg", "ruli (5).jpg", "ruli (6).jpg"],
    "propeller": ["propeller (1).jpg", "propeller (2).jpg", "propeller (3).jpg", "propeller (4).jpg",
                  "propeller (5).jpg", "propeller (6).jpg", "propeller (7).jpg", "propeller (8).jpg",
                  "propeller (9).jpg", "propeller (10).jpg", "propeller (11).jpg", "propeller (12).jpg",
                  "propeller (13).jpg"],
    "engine": ["stern_hull_01.jpg", "stern_hull_02.jpg", "stern_hull_03.jpg", "stern_hull_04.jpg",
               "stern_hull_05.jpg", "stern_hull_06.jpg", "stern_hull_07.jpg"],
}

# ---- FIXED VALUES: report conclusion; kind, issue, band in lower case, score ----
CONCLUSION_TEXT = (
    "По итогам %s на осмотренном участке чаще других фиксировался признак - %s. "
    "Совокупная оценка состояния участка соответствует уровню %s риска (%.3f). "
    "Признаков аварийного состояния по результатам текущего анализа не выявлено, однако участок требует планового наблюдения и повторной проверки в рамках следующего цикла осмотра. "
    "При следующем обследовании рекомендуется уделить внимание зонам, где дополнительные признаки повторяются на нескольких кадрах подряд, чтобы подтвердить их устойчивость и уточнить необходимость профилактических работ."
)
# the report's sentence on a run: kind, issue, band, score, urgency
SUMMARY_TEXT = (
    "%s показала, что среди выявленных не-фоновых признаков чаще всего отмечался признак \"%s\". "
    "Интегральный риск оценивается как %s (%.3f), приоритет действий - %s."
)
SOURCE_PLACEHOLDER = "Источник не указан"
KIND_LABELS = {"photo": "Фотоинспекция", "video": "Видеоинспекция"}
UNKNOWN_COLOR = "#94a3b8"
