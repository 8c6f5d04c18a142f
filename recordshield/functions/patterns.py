r"""Patterns and masks that fix the results.

Java dialect: ``(?P<n>`` is written ``(?<n>``, verbose patterns are on one line.
"""

# --- fixed values -----------------------------------------------------------------------------------------------------

MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t)?(?:ember)?|"
    r"Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)

# dates as they appear inside free text; the word boundaries and the look at the first letter are shared by all forms
NOTE_DATE = (
    r"\b(?=[0-9JFMASOND])(?:"
    + "|".join(
        [
            r"\d{4}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01])(?:\s\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?)?",
            r"(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-]\d{4}",
            r"(?:0?[1-9]|1[0-2])\.(?:0?[1-9]|[12]\d|3[01])\.\d{4}",
            r"(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-]\d{2}",
            r"(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-]\d{4}",
            r"\d{1,2}\s" + MONTH + r"\s\d{4}",
            MONTH + r"\s\d{1,2}(?:st|nd|rd|th)?[,/\s-]?\s?\d{4}",
            r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.\s\d{1,2}\.\d{4}",
        ]
    )
    + r")\b"
)

TIME_ONLY = r"^(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s?(?:AM|PM|am|pm))?$"

IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9][0-9]?)\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URLS = [
    r"\bhttps?://[^\s<>\"']+",
    r"\bwww\.[^\s<>\"']+",
    r"\bhttps{2,}://[^\s<>\"']+",
    r"\b(?:w{1,2}|w[a-z]w|w[a-z]{2})\.[^\s<>\"']+",
    r"\b[a-z0-9-]+\.(?:com|net|org|edu|gov|ai|io|in|co)(?:/[^\s<>\"']*)?",
]
PHONE = r"(?<!\d)(?:\+1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}(?!\d)"
PHONES = [
    r"\(\d{3}\)\s*\d{3}-\d{4}",
    r"\b\d{3}-\d{3}-\d{4}\b",
    r"\+\d{1,3}\s\d{1,4}[- ]\d{3}[- ]\d{4}\b",
    r"\b\d{3} \d{3} \d{4}\b",
]
SSN = r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"
DRIVER_LICENSES = [
    r"\b(?:DL|DL#|DL No\.?|License No\.?|Driver'?s License)\s*[:#]?\s*[A-Z]?\d{5,13}\b",
    r"\b[A-Z]\d{7}\b",
    r"\b[A-Z]\d{11}\b",
    r"\b[A-Z]\d{12}\b",
    r"\b[A-Z]{1,2}\d{6,12}[A-Z]?\b",
]

US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

_STATE = "(?:" + "|".join(US_STATES) + ")"
STATE_AND_ZIP = r"[,\s]" + _STATE + r"[\s,]*\d{5}"
# the look-ahead changes no match: it only ends hopeless tries early, before the nested runs are attempted
ADDRESS = (
    r"(?i)(?=\d[A-Za-z0-9\s.,'-]*?" + STATE_AND_ZIP + r")(?<number>\d+[A-Za-z]{0,3})"
    r"[\s,]*(?<street>[A-Za-z0-9\s.,'-]+)[,\s]+(?<city>[A-Za-z\s]+?)[,\s]+"
    r"(?<state>" + _STATE + r")[\s,]*(?<zip>\d{3})\d{2}(?:-\d{4})?"
)
ADDRESS_MASK = r"((HouseNumber)) ((StreetName)), ((City)), ((State)) ${zip}"
PO_BOX = r"(?i)\bP\.?\s?O\.?\s?Box\s+\d+\b"

VALID_ZIP = r"^\d{5}$"
VALID_ICD10 = r"^[A-Z]\d{2}(\.\d{1,4})?$"
VALID_PHONE = r"^\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(\s*x\d+)?$"
VALID_EMAIL = r"^[\w.-]+@[\w.-]+\.\w+$"
VALID_SSN = r"^\d{3}-\d{2}-\d{4}$"
VALID_SEX = ["male", "female", "other", "unknown"]

NULL_WORDS = ["", "none", "nan", "null"]
ZERO_DATES = ["0000-00-00", "0000-00-00 00:00:00"]

DEFAULT_STATIC_OFFSET = 34
MASKS = {
    "ip": "((IPADDRESS))",
    "email": "((EMAIL))",
    "url": "((URL))",
    "phone": "((PHONE_NUMBER))",
    "driver_license": "((DRIVERSLICENSE))",
    "facility": "((FacilityLocation))",
    "email_id": "((EMAIL_ID))",
    "ssn": "((SSN))",
}

XML_TAG_MASKS = {
    "SSN": "((SSN))",
    "address": "((ADDRESS))",
    "Address": "((ADDRESS))",
    "patientname": "((PATIENTNAME))",
    "GuarantorName": "((GUARANTORNAME))",
    "InsuranceId": "((INSURANCEID))",
    "postalCode": "((ZipCode))",
    "PatientId": "((PatientId))",
    "EncounterId": "((EncounterId))",
    "AddressLine1": "((AddressLine1))",
    "AddressLine2": "((AddressLine2))",
    "City": "((City))",
    "FirstName": "((FirstName))",
    "MiddleName": "((MiddleName))",
    "LastName": "((LastName))",
}
XML_ZIP_TAGS = ["zip", "zipcode", "postalcode"]
XML_DOB_TAGS = ["dob", "dateofbirth", "ptdob", "birthTime"]

QC_REASONS = {
    1: "data discrepancy present",
    2: "length verification failed",
    3: "prefix verification failed",
    4: "static offset not applied",
    5: "mask not applied",
    6: "dob rule not correctly applied",
    7: "date offset not correctly applied for some rows",
    8: "zip code rule not applied correctly for some rows",
}

# --- end of fixed values ----------------------------------------------------------------------------------------------


# what a text must hold for a kind to match at all; quick to test, so most texts skip the full pattern
NEEDED = {
    "ip": r"\d\.\d",
    "email": "@",
    "url": r"://|\.[^\s<>\"']",
    "phone": r"\d{4}",
    "driver_license": r"\d{5}",
    "address": r"\d{5}",
}


def any_of(patterns: list[str]) -> str:
    """One case-insensitive alternation, so that a text is scanned once per kind and not once per pattern."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)
