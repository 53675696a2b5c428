"""Workbooks for the tests, written with the package's own writer: a depot's stock, plan and reports."""

from gridloom.sinks.xlsx import BOLD, BOLD_BORDERED, HEADER, Cell, Sheet, Table, write

STOCK = ["SKU", "Bin", "Units", "Unit cost", "Stock value"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug"]


class Grid:
    """Cells by address, as rows from the first on."""

    def __init__(self):
        self.cells: dict[tuple[int, int], object] = {}

    def down(self, row: int, column: int, values) -> "Grid":
        for k, v in enumerate(values):
            self.cells[row + k, column] = v
        return self

    def across(self, row: int, column: int, values, style=None) -> "Grid":
        for k, v in enumerate(values):
            self.cells[row, column + k] = v if style is None else Cell(v, style)
        return self

    def rows(self) -> list[list]:
        last, width = (max(at[i] for at in self.cells) for i in (0, 1))
        return [[self.cells.get((r, c)) for c in range(1, width + 1)] for r in range(1, last + 1)]


def calc(text: str, value) -> Cell:
    return Cell(value, formula=text)


def settings() -> Grid:
    g = Grid().across(2, 2, ["Depot model: settings"], BOLD)
    g.down(4, 2, ["Opening hours", "Pallets per truck", "Spoilage", "Wage per hour", "Diesel price", "Safety stock"]).down(4, 3, ["06:00-22:00", 33, 0.015, 18.4, 1.62, 250])
    return g.across(13, 2, ["Ask the planning desk before changing a setting; last agreed with the drivers in March."])


def stock() -> Grid:
    g = Grid().across(3, 1, STOCK, HEADER)
    for k in range(24):
        r, units, cost = 4 + k, 12 + 5 * k, 3.5 + k / 4
        g.across(r, 1, [f"SKU-{k:04d}", f"B{k % 6 + 1}", units, cost, calc(f"ROUND(C{r}*D{r},2)", round(units * cost, 2))])
    g.across(5, 8, ["Bin", "Aisle", "Degrees"], BOLD_BORDERED)
    for k in range(6):
        g.across(6 + k, 8, [f"B{k + 1}", f"Aisle {chr(80 + k)}", 4.0 + 3 * k])
    return g


def plan() -> Grid:
    g = Grid().across(1, 2, ["Pallets by month and depot"], BOLD)
    for c, name in ((3, "North"), (5, "South"), (7, "Both depots")):
        g.across(4, c, [name], HEADER)
    g.across(5, 2, ["Month", "In", "Out", "In", "Out", "In", "Lost"])
    for k, month in enumerate(MONTHS):
        r = 6 + k + (k > 4)  # a blank row after May
        g.across(r, 2, [month, 900 + k, calc(f"C{r}*(1-Settings!$C$6)", 886.5 + k), calc(f"C{r}/2+10", 460 + k / 2), calc(f"E{r}*(1-Settings!$C$6)", 453.1 + k), calc(f"C{r}+E{r}", 1360 + 1.5 * k), calc(f"G{r}-D{r}-F{r}", 20.4)])
    g.across(15, 2, [Cell("Total", BOLD), *(Cell(7000.0 + c, BOLD, f"SUM({x}6:{x}10)+SUM({x}12:{x}14)") for c, x in enumerate("CDEFGH"))])
    g.down(7, 11, ["Trucks needed", calc("G15/Settings!C5", 21.2), calc("K8/K10", "#DIV/0!"), 0])
    return g.down(20, 2, ["Notes", "The south depot was closed for two weeks in spring, so its figures for April are estimates."])


def report() -> Grid:
    g = Grid().across(2, 3, ["Weekly report"], BOLD).across(4, 3, ["Depot", "Week 1", "Week 2", "Week 3", "All"], BOLD_BORDERED)
    for k, name in enumerate(["North", "South", "Harbour", "Airport", "Night"]):
        r = 5 + k
        g.across(r, 3, [name, 110.0 + k, 120.0 + k, 130.0 + k, calc(f"SUM(D{r}:F{r})", 360.0 + 3 * k)])
    return g


def scratch() -> Grid:
    g = Grid()
    for r in range(1, 15):
        g.across(r, 2, [r * 1.5, calc(f"B{r}+1", r * 1.5 + 1), calc(f"C{r}*B{r}", (r * 1.5 + 1) * r * 1.5)])
    return g


def depot_sheets() -> list[Sheet]:
    """Five sheets: settings, a declared table beside a lookup, a plan under a merged header with a blank row, a report, hidden workings."""
    return [
        Sheet("Settings", settings().rows()), Sheet("Stock data", stock().rows(), tables=[Table("stockList", "A3:E27", STOCK)]), Sheet("Plan calc", plan().rows(), merges=["C4:D4", "E4:F4", "G4:H4"]),
        Sheet("Weekly report", report().rows()), Sheet("tmp_workings", scratch().rows(), state="hidden"),
    ]


def counted(sheets: list[Sheet]) -> tuple[int, int]:
    """Cells and formulas."""
    cells = [v for s in sheets for row in s.rows for v in row if v is not None]
    return len(cells), sum(isinstance(v, Cell) and bool(v.formula) for v in cells)


TRUTH = {
    ("Settings", "B2:C9"): "key_value", ("Settings", "B13:B13"): "notes", ("Stock data", "A3:E27"): "data_table", ("Stock data", "H5:J11"): "data_table", ("Plan calc", "B1:B1"): "title",
    ("Plan calc", "B4:H15"): "calculation", ("Plan calc", "K7:K10"): "data_table", ("Plan calc", "B20:B21"): "notes", ("Weekly report", "C2:G9"): "data_table", ("tmp_workings", "B1:D14"): "calculation",
}
HEADERS = {("Stock data", "A3:E27"): STOCK, ("Plan calc", "B4:H15"): ["Month", "North::In", "North::Out", "South::In", "South::Out", "Both depots::In", "Both depots::Lost"]}


def write_estate(folder) -> None:
    """Four files: the depot's workbook, a copy with another name, a data file, and one that is no workbook."""
    write(folder / "depot.xlsx", depot_sheets(), creator="A. Author", links=("file:///C:/share/Fleet%20list%20v3.xlsx",), connections=({"name": "Ledger", "connection": "server=x;password=y"},))
    copy = depot_sheets()
    copy[0].rows = [*copy[0].rows, [], ["Second copy"]]
    write(folder / "copy of depot.xlsm", copy, creator="B. Author", vba=True)
    write(folder / "rates.xlsx", [Sheet("Rates", [[Cell("Currency", HEADER), Cell("Rate", HEADER)], *[[c, n] for n, c in enumerate("GBP USD EUR JPY HKD SGD".split(), 1)]])])
    (folder / "broken.xlsx").write_bytes(b"not an OOXML workbook")
    (folder / "~$depot.xlsx").write_bytes(b"lock")
