"""Word lists, label maps and constants that define results. Any of them can be replaced by an argument."""

# Keywords of the relevance score.
RELEVANCE_KEYWORDS = [
    "policy", "eligibility", "income", "household", "application", "determination", "benefit", "enrollment", "demographics",
    "address", "applicant", "date of birth", "ssn", "submit", "upload", "form", "table", "total", "guidance", "regulation", "requirement",
]

# Section types in order of precedence, with their keywords.
SECTION_RULES = {
    "demographics": ["name", "address", "date of birth", "ssn", "gender", "age", "contact", "phone", "email"],
    "income": ["income", "wages", "salary", "earnings", "employment", "employer", "pay"],
    "household": ["household", "members", "dependents", "family", "spouse", "children"],
    "eligibility": ["eligible", "eligibility", "qualify", "qualified", "determination", "approved", "denied"],
    "policy_guidance": ["policy", "regulation", "rule", "guidance", "requirement", "criteria"],
    "application_step": ["step", "submit", "continue", "next", "apply", "application", "form", "upload"],
    "table": ["table", "row", "column", "total", "amount", "quantity"],
}

# Headings, order weights and report buckets of section types; report buckets of model labels.
HEADINGS = {
    "demographics": "Applicant Demographics", "income": "Income & Employment Information", "household": "Household Composition",
    "eligibility": "Eligibility Determination", "policy_guidance": "Policy Guidance & Regulations",
    "application_step": "Application Process Step", "table": "Data Table / Summary", "unknown": "Uncategorized Content",
}
ORDER_WEIGHTS = {"demographics": 10, "income": 20, "household": 30, "eligibility": 40, "policy_guidance": 50, "application_step": 60, "table": 70, "unknown": 99}
SECTION_BUCKETS = {"demographics": 2, "income": 2, "household": 2, "application_step": 2, "eligibility": 3, "policy_guidance": 4, "table": 5, "unknown": 5}
LABEL_BUCKETS = {"Case List": 1, "Program Eligibility": 2, "Eligibility Evidence": 3, "State Eligibility": 4, "State Eligibility Determination": 4, "Unknown": 5}
BUCKETS = [1, 2, 3, 4, 5]

# Words that are no part of an automatic title.
TITLE_STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought
and but or nor not so yet both either neither each every all any few more most other some such no only own same than
too very just because as until while of at by for with about against between through during before after above below to from up
down in out on off over under again further then once here there when where why how this that these those i me my myself we
our ours you your yours he him his she her hers it its they them their what which who whom if else also into page click enter
select please next back home menu file edit view help new open close save print search
""".split()

# Labels of form fields.
FORM_LABELS = [x.strip() for x in """
name, first name, last name, middle name, full name, maiden name, suffix, prefix, title, date of birth, dob, birth date, age, gender, sex,
race, ethnicity, nationality, citizenship, language, ssn, social security, social security number, driver license, drivers license, dl number, passport,
address, street, street address, mailing address, city, state, zip, zip code, county, country, phone, telephone, cell, mobile, fax, email,
home phone, work phone, cell phone, email address, emergency contact, contact name, contact phone,
employer, employer name, occupation, job title, income, salary, wages, annual income, monthly income, gross income, net income, hourly rate,
bank name, routing number, account number, marital status, status, relationship, spouse, spouse name, beneficiary, beneficiary name,
case number, case id, application number, application id, policy number, policy id, member id, member number, group number, group id,
subscriber id, enrollee id, claim number, authorization number, approval number, certificate number, contract number,
effective date, start date, end date, expiration date, termination date, renewal date, issue date, filing date, date received, date submitted,
date of service, date of loss, date of injury, date of accident, plan, plan name, plan type, coverage, coverage type, premium, deductible, copay,
copayment, coinsurance, out of pocket, out of pocket max, annual max, lifetime max, benefit amount, benefit period, waiting period,
provider, physician, doctor, facility, hospital, npi, tax id, ein, tin, diagnosis, diagnosis code, procedure, procedure code, medication,
prescription, dosage, pharmacy, primary diagnosis, secondary diagnosis, referring provider, attending physician, rendering provider,
place of service, service date, admission date, discharge date, total, subtotal, amount, balance, payment, amount due, amount paid,
total charges, total payment, billed amount, allowed amount, paid amount, patient responsibility, coinsurance amount,
signature, date signed, applicant, representative, household size, number of dependents, dependents, reason, description, comments, notes,
type, category, class, level, tier
""".replace("\n", " ").split(",")]

# States.
STATE_CODES = """AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC""".split()
STATE_NAMES = [x.strip() for x in """
Alabama, Alaska, Arizona, Arkansas, California, Colorado, Connecticut, Delaware, Florida, Georgia, Hawaii, Idaho, Illinois, Indiana, Iowa, Kansas,
Kentucky, Louisiana, Maine, Maryland, Massachusetts, Michigan, Minnesota, Mississippi, Missouri, Montana, Nebraska, Nevada, New Hampshire,
New Jersey, New Mexico, New York, North Carolina, North Dakota, Ohio, Oklahoma, Oregon, Pennsylvania, Rhode Island, South Carolina, South Dakota,
Tennessee, Texas, Utah, Vermont, Virginia, Washington, West Virginia, Wisconsin, Wyoming, District of Columbia
""".replace("\n", " ").split(",")]

# Capitalised words that are no part of a person's name.
NOT_NAMES = """
The This That These Those There Their They What When Where Which While With Within Without About Above After Again Against Along Also
Among Around Before Below Between Beyond Both Could Dear Does Down During Each Either Else Every From Have Here How Into Just Like
Many More Most Much Must Near Never Next None North South East West Note Notes Notice Only Other Over Page Part Please Rather Same
Shall Should Since Some Still Such Sure Take Than Then Under Until Upon Very Were Will Would Your Section Total Amount Date Time
Subject Sincerely Regards Thank Thanks January February March April May June July August September October November December
Monday Tuesday Wednesday Thursday Friday Saturday Sunday New Old Not Now Our Out Own Per See Set She Too Use Way Was You All And
Are But For Get Got Had Has Her Him His Its Let Nor Off One Put Ran Say Two Who Why Yes Yet Effective Coverage Premium Benefits Insurance
National Federal General Standard Special Information Application Authorization Certification
""".split()

# Surface form, canonical name and label of the normalization table.
NORMALIZATION = [
    ("elderly & disabled", "ABD", "ELIGIBILITY_GROUP"), ("elderly and disabled", "ABD", "ELIGIBILITY_GROUP"),
    ("aged blind disabled", "ABD", "ELIGIBILITY_GROUP"), ("aged, blind, and disabled", "ABD", "ELIGIBILITY_GROUP"), ("abd", "ABD", "ELIGIBILITY_GROUP"),
    ("1115", "WAIVER_1115", "WAIVER_OR_AUTHORITY"), ("section 1115", "WAIVER_1115", "WAIVER_OR_AUTHORITY"),
    ("1115 demonstration", "WAIVER_1115", "WAIVER_OR_AUTHORITY"), ("1115 waiver", "WAIVER_1115", "WAIVER_OR_AUTHORITY"),
    ("1915(c)", "WAIVER_1915C", "WAIVER_OR_AUTHORITY"), ("1915c", "WAIVER_1915C", "WAIVER_OR_AUTHORITY"),
    ("1915(b)", "WAIVER_1915B", "WAIVER_OR_AUTHORITY"), ("1915b", "WAIVER_1915B", "WAIVER_OR_AUTHORITY"),
    ("fee for service", "FFS", "PAYMENT_OR_DELIVERY_MODEL"), ("fee-for-service", "FFS", "PAYMENT_OR_DELIVERY_MODEL"), ("ffs", "FFS", "PAYMENT_OR_DELIVERY_MODEL"),
    ("federally qualified health center", "FQHC", "PROVIDER_TYPE"), ("fqhc", "FQHC", "PROVIDER_TYPE"), ("rural health clinic", "RHC", "PROVIDER_TYPE"), ("rhc", "RHC", "PROVIDER_TYPE"),
    ("renewal", "ELIGIBILITY_REVIEW", "APPLICATION_PROCESS"), ("redetermination", "ELIGIBILITY_REVIEW", "APPLICATION_PROCESS"), ("recertification", "ELIGIBILITY_REVIEW", "APPLICATION_PROCESS"),
    ("centers for medicare and medicaid services", "CMS", "AGENCY_OR_GOV_BODY"), ("centers for medicare & medicaid services", "CMS", "AGENCY_OR_GOV_BODY"),
    ("home and community-based services", "HCBS", "PROGRAM_TYPE"), ("home and community based services", "HCBS", "PROGRAM_TYPE"),
    ("long-term services and supports", "LTSS", "PROGRAM_TYPE"), ("long term services and supports", "LTSS", "PROGRAM_TYPE"),
    ("managed long-term services and supports", "MLTSS", "PAYMENT_OR_DELIVERY_MODEL"), ("managed long term services and supports", "MLTSS", "PAYMENT_OR_DELIVERY_MODEL"),
]

# The labels of the domain tagger and what they stand for.
ENTITY_LABELS = {
    "PROGRAM_BRAND": "State-specific Medicaid program names",
    "PROGRAM_TYPE": "Program categories (Medicaid, CHIP, managed care, etc.)",
    "AGENCY_OR_GOV_BODY": "Government agencies and bodies",
    "ELIGIBILITY_GROUP": "Population/eligibility categories",
    "PERSON_ROLE": "Roles in the Medicaid system",
    "FINANCIAL_TERM": "Financial and eligibility terms",
    "APPLICATION_PROCESS": "Enrollment/application process terms",
    "BENEFIT_OR_SERVICE": "Covered benefits and services",
    "CARE_SETTING": "Healthcare settings and facilities",
    "PROVIDER_TYPE": "Provider categories",
    "PAYMENT_OR_DELIVERY_MODEL": "Payment and delivery models",
    "WAIVER_OR_AUTHORITY": "Federal waivers and authorities",
    "DOCUMENT_OR_RECORD": "Documents, records, and forms",
    "QUALITY_OR_COMPLIANCE": "Quality, fraud, and compliance terms",
    "TECH_OR_SYSTEM": "Technology and system terms",
    "SOCIAL_SUPPORT_OR_COMMUNITY_NEED": "Social determinants and community needs",
    "LOCATION": "Geographic references",
    "ACRONYM": "Medicaid/healthcare acronyms",
}

# The order of entity types in category maps.
ENTITY_TYPES = """date time_value currency email phone percentage ssn ein npi medical_code claim_number group_number policy_number case_number
address zip_code state account_number person_name organization url id_number""".split()

# Entity patterns in order of precedence (Java syntax; (?U) is not set, so classes are ASCII).
_STREET = r"(?:St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Dr(?:ive)?|Rd|Road|Ln|Lane|Ct|Court|Pl(?:ace)?|Way|Cir(?:cle)?|Pkwy|Parkway|Ter(?:race)?|Trail|Trl|Hwy|Highway)"
_ORG = r"(?:Inc\.?|LLC|L\.L\.C\.?|Corp(?:oration)?\.?|Ltd\.?|Co\.?|LP|L\.P\.?|LLP|L\.L\.P\.?|PLC|Group|Foundation|Association|Partners|Consulting|Services|Solutions|Technologies|Systems|Insurance|Mutual|Health|Medical|Hospital|Clinic|University|Agency|Bureau|Department|Commission|Authority|Board)"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_M, _D, _Y = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])", r"(?:19|20)\d{2}"
ENTITY_PATTERNS = [
    ("url", r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ein", r"(?i)\b(?:EIN[\s:]+\d{2}-\d{7}|(?:Tax\s*(?:ID|Identification)\s*(?:Number|No\.?)?|TIN)[\s:]+\d{2}-\d{7}|(?:FEIN|Employer\s+ID)[\s:]+\d{2}-\d{7})\b"),
    ("medical_code", r"(?i)\b(?:[A-TV-Z]\d{2}(?:\.\d{1,4})?|(?:CPT|HCPCS)[\s:#]*\d{5}|DRG[\s:#]*\d{3}|NDC[\s:#]*\d{5}-\d{4}-\d{2}|Rev(?:enue)?\s+Code[\s:#]*\d{4})\b"),
    ("claim_number", r"(?i)\b(?:(?:Claim|CLM|Auth(?:orization)?|Prior\s+Auth)[\s:#]*[A-Z0-9][\w\-]{4,20}|(?:Approval|Confirmation|Transaction|Reference)\s*(?:#|No\.?|Number)\s*[A-Z0-9][\w\-]{4,20})\b"),
    ("group_number", r"(?i)\b(?:(?:Group|GRP|Plan|Benefit)\s*(?:#|No\.?|Number|ID)[\s:]*[A-Z0-9][\w\-]{2,15}|(?:Subscriber|Member|Enrollee)\s*(?:#|No\.?|Number|ID)[\s:]*[A-Z0-9][\w\-]{3,15})\b"),
    ("phone", r"(?:\+?1[\s\-]?)?(?:\(\d{3}\)[\s\-]?\d{3}[\s\-]?\d{4}|\d{3}[\s\-]\d{3}[\s\-]\d{4}|\+1\d{10}|\d{3}\.\d{3}\.\d{4}|\+\d{1,3}[\s\-]\d{1,4}[\s\-]\d{4,10})\b"),
    ("currency", r"(?i)(?:\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\bUSD\s?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\bEUR\s?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?|\bGBP\s?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|£\s?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|€\s?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?)"),
    ("percentage", r"\b\d+(?:\.\d+)?%"),
    ("date", rf"\b(?:{_M}[/\-.]{_D}[/\-.]{_Y}|{_Y}[/\-]{_M}[/\-]{_D}|{_MONTH}\s+\d{{1,2}},?\s+{_Y}|{_MON}\.?\s+\d{{1,2}},?\s+{_Y}|\d{{1,2}}\s+{_MONTH}\s+{_Y}|\d{{1,2}}-{_MON}-{_Y}|{_M}[/\-]{_D}[/\-]\d{{2}}(?!\d))\b"),
    ("time_value", r"\b(?:(?:1[0-2]|0?[1-9]):[0-5]\d\s*(?:AM|PM|am|pm|a\.m\.|p\.m\.)|(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)\b"),
    ("zip_code", r"\b(?:(?:ZIP|Zip|zip)[\s:]*\d{5}(?:-\d{4})?|(?<=[A-Z]{2}\s)\d{5}(?:-\d{4})?)\b"),
    ("policy_number", r"(?i)\b(?:POL[\-#]?\s?\d[\d\-]+|Policy\s*#?\s*\d[\d\-]+|(?:Certificate|Cert)\s*(?:#|No\.?)\s*\d[\d\-]+|(?:Contract|Account)\s*(?:#|No\.?)\s*\d[\d\-]+)\b"),
    ("case_number", r"(?i)\b(?:Case\s*(?:#|No\.?)\s*\d[\d\-]+|Ref(?:erence)?\s*(?:#|No\.?)\s*\d[\d\-]+|(?:Docket|File|Matter)\s*(?:#|No\.?)\s*\d[\d\-]+|(?:Ticket|Incident)\s*(?:#|No\.?)\s*[A-Z0-9][\w\-]+)\b"),
    ("address", r"\b\d{1,6}\s+(?:[A-Z][a-z]+\s+){0,3}" + _STREET + r"\.?(?:,?\s+(?:[A-Z][a-z]+\.?\s*)+,?\s+(?:" + "|".join(STATE_CODES) + r")\s+\d{5}(?:-\d{4})?)?"),
    ("account_number", r"(?i)\b(?:(?:Account|Acct|A/C)[\s:#]*\d{6,17}|(?:Routing|ABA|RTN)[\s:#]*\d{9}|(?:IBAN)[\s:]*[A-Z]{2}\d{2}[A-Z0-9]{4,30})\b"),
    ("id_number", r"(?i)\b(?:ID[\s:]+\d{4,12}|No\.\s*\d{4,12}|#\d{4,12}|(?:License|DL|Driver'?s?\s*License)[\s:#]*[A-Z0-9]{5,15}|(?:Passport)[\s:#]*[A-Z0-9]{6,12}|(?:VIN)[\s:#]*[A-HJ-NPR-Z0-9]{17})\b"),
    ("npi", r"(?i)\b(?:NPI|National\s+Provider\s+(?:Identifier|ID))[\s:#]*\d{10}\b"),  # the span is that of the ten digits
    ("state", r"\b(?:" + "|".join(sorted(STATE_NAMES, key=len, reverse=True)) + r")\b"),
    ("organization", r"\b(?:[A-Z]{2,}(?:\s+[A-Z]{2,})+)\b"),
    ("organization", r"\b(?:[A-Z][A-Za-z&]+(?:\s+[A-Z][A-Za-z&]+)*)\s+" + _ORG + r"\b"),
    ("person_name", r"\b[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){1,2}\b"),
]
