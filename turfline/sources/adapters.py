"""Layouts of the state roll files.  A state is added by adding a layout, not code."""

from __future__ import annotations

from dataclasses import dataclass, field

ColumnRef = str | int | tuple[int, ...] | tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """How one state writes its roll: header names, 1-based positions, or several columns to join."""

    jurisdiction: str
    delimiter: str
    encoding: str
    header: bool
    date_format: str
    active: tuple[str, ...]
    cancelled: tuple[str, ...]
    columns: dict[str, ColumnRef] = field(hash=False)
    confidence: str = "high"
    verified_as_of: str = "2026-06-07"
    layout_revision: str | None = None

    def refs(self, name: str) -> tuple[str | int, ...]:
        ref = self.columns.get(name, ())
        return ref if isinstance(ref, tuple) else (ref,)

    @property
    def charset(self) -> str:
        """utf-8, else the single-byte Western charset that covers ascii and latin1."""
        return "UTF-8" if "utf" in self.encoding.lower() else "ISO-8859-1"

    @property
    def width(self) -> int:
        return max((r for name in self.columns for r in self.refs(name) if isinstance(r, int)), default=0)


# --- fixed values: the seven published layouts ------------------------------------
LAYOUTS = {
    layout.jurisdiction: layout
    for layout in (
        Layout(
            "North Carolina", "\t", "windows-1252", True, "MM/DD/YYYY", ("A", "ACTIVE"), ("R", "D"),
            {
                "voter_id": "ncid", "first_name": "first_name", "middle_name": "middle_name",
                "last_name": "last_name", "suffix": "name_suffix_lbl", "street_address": "res_street_address",
                "city": "res_city_desc", "state": "state_cd", "zip": "zip_code", "status": "status_cd",
                "registered": "registr_dt", "county": "county_desc", "district": "nc_house_abbrv",
                "tile_cell": "precinct_abbrv",
            },
            layout_revision="2026-02-02",
        ),
        Layout(
            "Ohio", ",", "utf-8", True, "MM/DD/YYYY", ("ACTIVE",), ("CANCELLED",),
            {
                "voter_id": "SOS_VOTERID", "first_name": "FIRST_NAME", "middle_name": "MIDDLE_NAME",
                "last_name": "LAST_NAME", "suffix": "SUFFIX", "street_address": "RESIDENTIAL_ADDRESS1",
                "unit": "RESIDENTIAL_SECONDARY_ADDR", "city": "RESIDENTIAL_CITY", "state": "RESIDENTIAL_STATE",
                "zip": "RESIDENTIAL_ZIP", "status": "VOTER_STATUS", "registered": "REGISTRATION_DATE",
                "county": "COUNTY_NUMBER", "district": "CONGRESSIONAL_DISTRICT", "tile_cell": "PRECINCT_CODE",
            },
            confidence="medium",
        ),
        Layout(
            "Mississippi", ",", "utf-8", True, "unknown", ("active",), ("purged", "canceled", "cancelled"),
            {
                "voter_id": "Mapping Value", "first_name": "First Name", "middle_name": "Middle Name",
                "last_name": "Last Name", "suffix": "Suffix", "street_address": "Residential Address",
                "house": "House Number", "street_name": "Street Name", "city": "Residence City",
                "state": "Residence State", "zip": "Residential Zip Code", "status": "Voter Status",
                "registered": "Effective Voter Registration Date", "county": "Residential County",
            },
            confidence="low",
        ),
        Layout(
            "Florida", "\t", "ascii", False, "MM/DD/YYYY", ("ACT",), (),
            {
                "county": 1, "voter_id": 2, "last_name": 3, "suffix": 4, "first_name": 5, "middle_name": 6,
                "street_address": (8, 9), "city": 10, "state": 11, "zip": 12, "registered": 23, "status": 29,
                "district": 30,
            },
            layout_revision="2026-05-04",
        ),
        Layout(
            "Oklahoma", ",", "utf-8", True, "MM/DD/YYYY", ("A",), (),
            {
                "voter_id": "VoterID", "first_name": "FirstName", "middle_name": "MiddleName",
                "last_name": "LastName", "suffix": "Suffix", "house": "StreetNum", "street_name": "StreetName",
                "unit": "BldgNum", "city": "City", "zip": "Zip", "status": "Status",
                "registered": "RegistrationDate", "county": "County_Desc", "district": "Precinct",
            },
        ),
        Layout(
            "Vermont", "|", "windows-1252", True, "MM/DD/YYYY", ("ACTIVE",), ("PURGED", "CANCELED"),
            {
                "voter_id": "Voter ID", "first_name": "First Name", "middle_name": "Middle Initial",
                "last_name": "Last Name", "suffix": "Suffix", "street_address": "Legal Address Line 1",
                "unit": "Legal Address Line 2", "city": "Legal Address City", "state": "Legal Address State",
                "zip": "Legal Address Zip", "status": "Status", "registered": "Date of Registration",
                "county": "County", "district": "Voting District",
            },
            confidence="medium",
        ),
        Layout(
            "Washington", "|", "windows-1252", True, "YYYY-MM-DD", ("Active",), (),
            {
                "voter_id": "StateVoterID", "first_name": "FName", "middle_name": "MName", "last_name": "LName",
                "suffix": "NameSuffix", "house": "RegStNum", "street_name": "RegStName", "unit": "RegUnitNum",
                "city": "RegCity", "state": "RegState", "zip": "RegZipCode", "status": "StatusCode",
                "registered": "Registrationdate", "county": "CountyCode", "district": "LegislativeDistrict",
            },
        ),
    )
}
