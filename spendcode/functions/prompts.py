"""Prompt texts of every model stage.

The request key hashes these texts, so they must equal the reference's byte for byte,
including the indentation its triple-quoted strings carry.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------
# System prompts, user-prompt frames and default settings.
# ``{text}``, ``{description}`` and ``{naics}`` mark where the line text is inserted.
# ---------------------------------------------------------------------------------------

P1_DETECT_SYSTEM = "You are a language detector. \n                Your task is to determine if the given text is in English.\n                Respond with only 'True' if the text is in English, or 'False' if it's in any other language."

P1_TRANSLATE_SYSTEM = 'You are a professional translator. \n                Your task is to translate the given text to English while maintaining its meaning and context.\n                Provide only the translation, without any additional text or explanations.'

P1_NAICS_SYSTEM = 'You are an expert in NAICS (North American Industry Classification System) classification. \n        Your task is to analyze the given text and determine the most appropriate NAICS code and description.\n        \n        Guidelines:\n        1. NAICS codes are 2-6 digits long\n        2. Choose the most specific code that matches the description\n        3. Consider both the primary activity and any significant secondary activities\n        4. If unsure, choose a more general code rather than an incorrect specific one\n        5. Provide a confidence score based on how well the description matches the NAICS code\n        \n        Format your response exactly as:\n        NAICS Code: [code]\n        NAICS Description: [description]\n        Confidence: [percentage]%\n        \n        Example:\n        NAICS Code: 541511\n        NAICS Description: Custom Computer Programming Services\n        Confidence: 95%'

P1_UNSPSC_SYSTEM = 'You are an expert in UNSPSC (United Nations Standard Products and Services Code) classification.\n        Your task is to analyze the given procurement description and NAICS classification to determine the most appropriate UNSPSC code and description.\n        \n        CRITICAL INSTRUCTIONS:\n        1. You must ONLY use existing, valid UNSPSC codes from the official UNSPSC system\n        2. Do NOT generate or make up codes - they must be real UNSPSC codes\n        3. The code must exactly match the description you provide\n        4. If you are not certain about the exact code, do not provide one\n        5. UNSPSC codes are hierarchical:\n           - First 2 digits: Segment (e.g., 43 for IT)\n           - First 4 digits: Family (e.g., 4321 for Software)\n           - First 6 digits: Class (e.g., 432115 for Business Software)\n        \n        Guidelines:\n        1. Choose the most specific 6-digit code that matches the description\n        2. Consider both the procurement description and NAICS classification for context\n        3. If unsure about the exact code, do not provide one\n        4. Provide a confidence score based on how well the description matches the UNSPSC code\n        5. The code and description must be from the official UNSPSC system\n        \n        Format your response exactly as:\n        UNSPSC Code: [6-digit code]\n        UNSPSC Description: [description]\n        Confidence: [percentage]%\n        \n        Example of valid UNSPSC codes:\n        UNSPSC Code: 432115\n        UNSPSC Description: Business application software\n        Confidence: 95%\n        \n        UNSPSC Code: 441115\n        UNSPSC Description: Desktop computers\n        Confidence: 95%'

P1_DESCRIBE_SYSTEM = 'You are an expert in UNSPSC classification. \n                For the given text, provide a detailed UNSPSC description that matches the official UNSPSC terminology.\n                Format your response as:\n                UNSPSC Description: [detailed description]'
P1_NAICS_USER = "Please classify the following business activity:\n\n{text}"
P1_UNSPSC_USER = ("Please classify the following procurement:\n\n"
                  "Procurement Description: {description}\n        NAICS Classification: {naics}")

P2_DETECT_SYSTEM = ("You are a language detector. Your task is to determine if the given text is in English. "
                    "Answer with only 'yes' or 'no'.")
P2_DETECT_USER = "\n        Is this text in English? Answer with only 'yes' or 'no':\n        {text}\n        "
P2_TRANSLATE_SYSTEM = ("You are a translator. Your task is to translate text to English. "
                       "Return only the translated text, nothing else.")
P2_TRANSLATE_USER = ("\n        Translate the following text to English. \n"
                     "        Return only the translated text, nothing else:\n        {text}\n        ")
P2_NAICS_SYSTEM = ("You are a NAICS code classifier. Your task is to analyze procurement descriptions "
                   "and return the most appropriate NAICS code with confidence level.")
P2_NAICS_USER = ("\n        Analyze this procurement description and determine the most appropriate NAICS code.\n"
                 "        Return the response in this exact format:\n"
                 "        NAICS Code: [6-digit code]\n"
                 "        Description: [brief description]\n"
                 "        Confidence: [percentage 0-100]\n"
                 "        \n"
                 "        Description to analyze:\n"
                 "        {text}\n        ")
P2_UNSPSC_SYSTEM = ("You are a UNSPSC code classifier. Your task is to analyze procurement and NAICS "
                    "descriptions and return the most appropriate UNSPSC code with confidence level.")
P2_UNSPSC_USER = ("\n        Analyze this procurement description and NAICS description to determine the most "
                  "appropriate UNSPSC code.\n"
                  "        Return the response in this exact format:\n"
                  "        UNSPSC Code: [8-digit code]\n"
                  "        Description: [brief description]\n"
                  "        Confidence: [percentage 0-100]\n"
                  "        \n"
                  "        Procurement Description:\n"
                  "        {description}\n"
                  "        \n"
                  "        NAICS Description:\n"
                  "        {naics}\n        ")

# Sampling temperature per stage, as text (it is part of the request key).
P1_TEMPERATURE = {"detect": "0.1", "translate": "0.3", "naics": "0.3", "unspsc": "0.3", "describe": "0.3"}
P2_TEMPERATURE = {"detect": "0", "translate": "0", "naics": "0", "unspsc": "0"}
# Answers that mean "the text is English" after strip() and lower().
P1_ENGLISH_ANSWER = "true"
P2_ENGLISH_ANSWER = "yes"
# Default settings of the application.
DEFAULT_MODEL = "classifier"  # model name passed to the injected client (part of the request key)
DEFAULT_THRESHOLD = 85
# What an f-string renders for a missing value in a prompt (str(NaN) / str(None)).
MISSING_TEXT = "nan"
MISSING_OBJECT = "None"

SYSTEM = {
    ("p1", "detect"): P1_DETECT_SYSTEM, ("p1", "translate"): P1_TRANSLATE_SYSTEM,
    ("p1", "naics"): P1_NAICS_SYSTEM, ("p1", "unspsc"): P1_UNSPSC_SYSTEM,
    ("p1", "describe"): P1_DESCRIBE_SYSTEM,
    ("p2", "detect"): P2_DETECT_SYSTEM, ("p2", "translate"): P2_TRANSLATE_SYSTEM,
    ("p2", "naics"): P2_NAICS_SYSTEM, ("p2", "unspsc"): P2_UNSPSC_SYSTEM,
}
USER = {
    ("p1", "detect"): "{text}", ("p1", "translate"): "{text}", ("p1", "naics"): P1_NAICS_USER,
    ("p1", "unspsc"): P1_UNSPSC_USER, ("p1", "describe"): "{text}",
    ("p2", "detect"): P2_DETECT_USER, ("p2", "translate"): P2_TRANSLATE_USER,
    ("p2", "naics"): P2_NAICS_USER, ("p2", "unspsc"): P2_UNSPSC_USER,
}
TEMPERATURE = {**{("p1", k): v for k, v in P1_TEMPERATURE.items()},
               **{("p2", k): v for k, v in P2_TEMPERATURE.items()}}


def split_frame(frame: str) -> list[str]:
    """Literal pieces and ``{name}`` slots of a user-prompt frame, in order."""
    import re
    return [p for p in re.split(r"(\{text\}|\{description\}|\{naics\})", frame) if p != ""]
