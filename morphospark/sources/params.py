"""Run parameters (flags and path templates) as a value object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RunParams:
    data_folder: str
    channels: int = 2
    zero_is_control: bool = True
    save_fig: bool = False
    save_csv: bool = False
    exclude_pairs: tuple = (("5FU", "ISO34"),)
    cells: tuple = ("ISO34", "ISO49")
    variables: tuple = ("Conc /uM", "Date", "Drug")
    feature_source: str = "scaled"  # P23: "selected", "weighted" or "scaled"
    seed: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def root_dir(self) -> str:
        return f"./analysed/{self.data_folder}/"

    def object_paths(self, variant: str = "projection_XY") -> dict:
        base = f"{self.root_dir}raw/{variant}/"
        return {"objects": base + "Secondary.csv", "images": base + "Image.csv",
                "organoids": base + "Primary.csv"}

    def output_prefix(self) -> str:
        return f"./graphs/{self.data_folder}_channels_{self.channels}"
