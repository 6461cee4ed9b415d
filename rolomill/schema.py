"""The contact table and the fixed values of its semantics."""

#: The eight fields in output order, by internal name and header.
HEADERS = {
    "first_name": "First Name",
    "last_name": "Last Name",
    "current_company": "Current Company",
    "role": "Designation / Role",
    "linkedin": "LinkedIn Profile URL",
    "email": "Email",
    "phone": "Phone Number",
    "geo": "Geo (Location by City)",
}
FIELDS = list(HEADERS)
#: The marker of a column that holds first and last name.
FULL_NAME = "FULL_NAME_TO_SPLIT"
#: Texts that mean null when a file is read.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Texts that cleaning makes empty.
BLANK_TOKENS = ["nan", "None", "null", ""]
#: The fields of which a row needs one; geo alone isn't enough.
VALUABLE = ["first_name", "last_name", "current_company", "role", "linkedin", "email", "phone"]
#: Headers of the two exports, in the order of FIELDS.
APOLLO = ["Contact first name", "Contact last name", "Account name", "Contact title", "Contact LinkedIn URL", "Contact email", "First phone", "Contact place city"]
HUBSPOT = ["First Name", "Last Name", "Company name", "Job Title", "LinkedIn URL", "Email", "Phone Number", "City"]
#: Least shares for a table to pass the quality gate.
QUALITY = {"name_coverage": 0.3, "email_validity": 0.8, "linkedin_validity": 0.7, "phone_validity": 0.6, "completeness": 0.2}
